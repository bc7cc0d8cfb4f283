"""Queries of the job store, of names and clock times, and of event-time windows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import geometry, text
from touchline.operators import jobs, masks, series
from touchline.plans.inputs import NOW, Registry, sessions, table, tasks, tracks
from touchline.sources import changes
from touchline.sources.folders import shared_folder
from touchline.streaming import windows

registry = Registry()
query = registry.query

KEPT = "(select * from sessions where id % 7 <> 0)"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without every seventh, so that some tasks have lost theirs."""
    return sessions(spark, sf_dir).where("id % 7 <> 0")


@query("select id, user_id, status from sessions where lower(name) like '%urgent%' and status like '%\\_failed' escape '\\'")
def sessions_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.find_sessions(sessions(spark, sf_dir), "Urgent", "failed").select("id", "user_id", "status")


@query("select id, user_id, status from sessions where status in ('uploading', 'uploaded', 'queued', 'tracking', 'tracking_done', 'analyzing')")
def sessions_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.find_sessions(sessions(spark, sf_dir), state="running").select("id", "user_id", "status")


@query("select id, user_id, status from sessions where user_id = 7")
def sessions_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.own_rows(sessions(spark, sf_dir), 7).select("id", "user_id", "status")


@query("""
, ranked as (select *, row_number() over (partition by session_id, task_type order by created_at desc, line, part) as place from tasks)
select session_id, task_type, line, part, status from ranked where place = 1""")
def latest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.latest(tasks(spark, sf_dir), ["session_id", "task_type"], [F.desc("created_at"), F.asc("line"), F.asc("part")])
    return found.select("session_id", "task_type", "line", "part", "status")


@query("""
, ranked as (select *, row_number() over (partition by user_id order by created_at desc, id) as place from sessions)
select user_id, id, cast(place as integer) as place from ranked where place <= 5""")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("created_at"), F.asc("id")]
    return jobs.first_of_each(sessions(spark, sf_dir).select("user_id", "id", "created_at"), ["user_id"], order, 5).drop("created_at")


@query("select session_id, line, part from tasks t where exists (select 1 from sessions s where s.id = t.session_id and s.user_id = 7)")
def tasks_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.own_tasks(tasks(spark, sf_dir), sessions(spark, sf_dir), 7).select("session_id", "line", "part")


@query(f"select session_id, line, part from tasks where session_id not in (select id from {KEPT})")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.orphans(tasks(spark, sf_dir), _kept(spark, sf_dir), "session_id", "id").select("session_id", "line", "part")


@query(f"select session_id, line, part from tasks where status = 'running' and created_at < timestamp '{NOW}' - interval 60 minute")
def zombie_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.zombies(tasks(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("session_id", "line", "part")


@query(f"select id, user_id from sessions where created_at < timestamp '{NOW}' - interval 700 day")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.expired(sessions(spark, sf_dir), "created_at", F.lit(NOW).cast("timestamp"), 700).select("id", "user_id")


@query("""
, parts as (select id, status, 0 as version from sessions union all select id, 'analysis_done', 1 from sessions where id % 3 = 0),
ranked as (select *, row_number() over (partition by id order by version desc) as place from parts)
select id, status from ranked where place = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = sessions(spark, sf_dir).select("id", "status", F.lit(0).alias("version"))
    new = old.where("id % 3 = 0").select("id", F.lit("analysis_done").alias("status"), F.lit(1).alias("version"))
    return jobs.latest(old.unionByName(new), ["id"], [F.desc("version")]).select("id", "status")


@query("""
, updates as (select id, case when id % 2 = 0 then 'analyzing' end as new_status from sessions where id % 5 = 0)
select id, coalesce(new_status, status) as status, name from sessions left join updates using (id)""")
def merge_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = sessions(spark, sf_dir).select("id", "status", "name")
    updates = current.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "analyzing").alias("status"))
    return jobs.merge_updates(current, updates, "id", ["status"])


@query("""
select event_id, case when event_id % 2 = 0 then cast(event_id as varchar) else json_extract_string(props, '$.k') end as k,
       case when event_id % 2 = 0 then 'done' end as stage from events""")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("event_id") % 2 == 0, F.to_json(F.create_map(F.lit("k"), F.col("event_id").cast("string"), F.lit("stage"), F.lit("done"))))
    merged = table(spark, sf_dir, "events").select("event_id", jobs.merge_json(F.col("props"), new).alias("extra"))
    return merged.select("event_id", *(F.get_json_object("extra", f"$.{k}").alias(k) for k in ("k", "stage")))


@query("select event_id, event_type, json_extract_string(props, '$.k') as k from events")
def session_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.flatten_extra(table(spark, sf_dir, "events"), ["k", "event_type"], "props").select("event_id", "event_type", "k")


@query("""
, uploads as (select id, cast(1 + id % 5 as integer) as n_parts from sessions),
wanted as (select id, cast(unnest(range(0, n_parts)) as integer) as part from uploads)
select id, part from wanted where not (part % 2 = 0 or id % 3 = 0)""")
def missing_upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = sessions(spark, sf_dir).select("id", (1 + F.col("id") % 5).cast("int").alias("n_parts"))
    parts = uploads.select("id", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part")).where("part % 2 = 0 or id % 3 = 0")
    return jobs.missing_parts(parts, uploads, "id")


@query("select distinct o_custkey as key from orders intersect select c_custkey from customer where c_nationkey < 10")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return buyers.intersect(table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("key")))


@query("""
, parts as (select session_id, frame, mx, 0 as part from tracks where frame < 30 union all select session_id, frame, my, 1 from tracks where frame >= 20),
ranked as (select *, row_number() over (partition by session_id, frame order by part desc) as place from parts)
select session_id, frame, mx as v, part from ranked where place = 1""")
def union_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir)
    first = rows.where("frame < 30").select("session_id", "frame", F.col("mx").alias("v"), F.lit(0).alias("part"))
    second = rows.where("frame >= 20").select("session_id", "frame", F.col("my").alias("v"), F.lit(1).alias("part"))
    return jobs.latest(first.unionByName(second), ["session_id", "frame"], [F.desc("part")])


@query("""
, numbered as (select session_id, frame, row_number() over (partition by session_id order by frame) as up, row_number() over (partition by session_id order by frame desc) as down from tracks)
select session_id, frame from numbered where up <> 1 and down <> 1""")
def evaluation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.inner_frames(tracks(spark, sf_dir).select("session_id", "frame"), ["session_id"])


@query("""
select event_id, lpad(cast(cast(floor(value / 60) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor(value) as bigint) % 60 as varchar), 2, '0') as clock,
       '#' || lower(lpad(to_hex(event_id % 256), 2, '0') || lpad(to_hex(event_id * 7 % 256), 2, '0') || lpad(to_hex(event_id * 13 % 256), 2, '0')) as colour
from events""")
def clock_and_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    colour = text.colour_to_hex(event * 13 % 256, event * 7 % 256, event % 256)
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.col("value")).alias("clock"), colour.alias("colour"))


@query("""
, named as (select page_id, url, regexp_extract(url, '^(?:[a-z]+://[^/]*)?([^?#]*)', 1) as path from pages),
parts as (select page_id, url, list_extract(string_split(path, '/'), -1) as last from named),
plain as (select *, regexp_replace(regexp_replace(last || case when page_id % 5 = 0 then repeat('x', 250) || '.mp4' else '' end, '[^A-Za-z0-9._\\- ()]+', '_', 'g'), '^[-.]+', '') as p from parts)
select page_id, case when last <> '' then last else substr(cast(page_id as varchar) || '-abcdefgh', 1, 8) end as name,
       lower(regexp_extract(last, '(\\.[^./]+)$', 1)) in ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v') as allowed,
       case when p = '' then 'video.mp4' when length(p) <= 200 then p when not contains(p, '.') then substr(p, 1, 200)
            else substr(regexp_extract(p, '^(.*)\\.', 1), 1, 180) || regexp_extract(p, '\\.[^.]*$') end as safe,
       case when lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) = 'example.com' then regexp_extract(url, '^https?://[^/]+/([^?#]+)', 1) end as storage_key
from plain""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, last = F.col("url"), F.element_at(F.split(F.regexp_extract("url", r"^(?:[a-z]+://[^/]*)?([^?#]*)", 1), "/"), -1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.name_from_url(url, F.concat(F.col("page_id").cast("string"), F.lit("-abcdefgh"))).alias("name"),
        text.allowed_extension(last).alias("allowed"),
        text.safe_filename(F.concat(last, F.when(F.col("page_id") % 5 == 0, "x" * 250 + ".mp4").otherwise(""))).alias("safe"),
        text.storage_key(url, "example.com").alias("storage_key"),
    )


@query("select (a.i + 0.5) / 8 as x, (b.i + 0.5) / 8 as y from range(8) a(i), range(8) b(i)")
def point_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.point_grid(spark, 8)


@query("""
select session_id, frame, round(mx + (my - mx) * (frame % 4) / 4, 6) as between_value, cast(floor(frame / 4.0 * 25) as bigint) as video_frame from tracks""")
def interpolated_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = (F.col("frame") % 4) / F.lit(4)
    value = F.round(geometry.between(F.col("mx"), F.col("my"), share), 6)
    return tracks(spark, sf_dir).select("session_id", "frame", value.alias("between_value"), geometry.frame_at(F.col("frame") / 4, 25.0).alias("video_frame"))


CENTS = "cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents"


@query(f"""
select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as window_start, event_type, count(*) as n, {CENTS} from events group by 1, 2""")
def event_windows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.windowed_counts(table(spark, sf_dir, "events"), "ts", F.window("ts", "1 hour"), ["event_type"])
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "cents")


@query(f"""
, slid as (select *, unnest(range(0, 2)) as back from events)
select cast(epoch(time_bucket(interval 30 minute, ts)) as bigint) - 1800 * back as window_start, event_type, count(*) as n, {CENTS} from slid group by 1, 2""")
def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.windowed_counts(table(spark, sf_dir, "events"), "ts", F.window("ts", "1 hour", "30 minutes"), ["event_type"])
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "cents")


@query(f"""
, marked as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 8 hour then 1 else 0 end as opens
             from events window w as (partition by user_id order by ts, event_id)),
runs as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from marked)
select cast(floor(epoch(min(ts))) as bigint) as window_start, user_id, count(*) as n, {CENTS} from runs group by user_id, run""")
def event_windows_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.windowed_counts(table(spark, sf_dir, "events"), "ts", F.session_window("ts", "8 hours"), ["user_id"])
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "user_id", "n", "cents")


TEAM = "case event_type when 'purchase' then 1 when 'signup' then 2 else 0 end"


@query(f"select user_id as session_id, {TEAM} as team, count(*) as frames from events group by 1, 2")
def streamed_possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possession counts kept up to date by a stream over the events, read back as a table."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream takes no single file
    team = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    folder = f"{shared_folder(spark)}/touchline/stream-{uuid.uuid4().hex}"
    control = rows.select(F.col("user_id").alias("session_id"), team.alias("team"))
    windows.control_stream(control, f"{folder}/checkpoint", f"{folder}/counts").awaitTermination()
    return windows.control_totals(spark, f"{folder}/counts")


@query("""
, held as (select *, lag(team) over (partition by session_id order by frame) as prior from tracks where team <> 0)
select session_id, frames, coalesce(switches, 0) as switches from (select session_id, count(*) as frames from tracks group by all)
left join (select session_id, count(*) filter (prior <> team) as switches from held group by all) using (session_id)""")
def carried_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of possession by a stream that gets the events in three chunks and carries its state across them."""
    team = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"), team.alias("team"))
    low, high = (F.lit(x) for x in rows.agg(F.percentile_approx(F.unix_micros("at.ts"), [0.3, 0.7])).first()[0])  # two numbers
    micros = F.unix_micros("at.ts")
    rows = rows.withColumn("at", F.format_string("%020d-%020d", micros, F.col("at.event_id")))
    chunk = F.when(micros_of(F.col("at")) < low, 0).when(micros_of(F.col("at")) < high, 1).otherwise(2)
    folder = f"{shared_folder(spark)}/touchline/carried-{uuid.uuid4().hex}"

    def stream():
        return windows.carried_switches(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/turn=*"), f"{folder}/checkpoint", f"{folder}/out")

    windows.in_turns([rows.where(chunk == k) for k in range(3)], f"{folder}/in", stream)
    return windows.latest_batch(spark, f"{folder}/out", "session_id").select("session_id", "frames", "switches")


def micros_of(at):
    """The time in a sortable text of time and number."""
    return F.split_part(at, F.lit("-"), F.lit(1)).cast("long")


@query("select session_id, line, part, status from tasks where session_id = 33")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one session's tasks, from the change source, as they arrive."""
    folder = f"{shared_folder(spark)}/touchline/changes-{uuid.uuid4().hex}"
    rows = tasks(spark, sf_dir).select("session_id", "line", "part", "status")
    changes.register(spark)
    feed = spark.readStream.format(changes.NAME).schema(rows.schema).options(path=f"{folder}/in", key="session_id", value="33")

    def stream():
        return windows.copy_stream(feed.load(), f"{folder}/checkpoint", f"{folder}/out")

    windows.in_turns([rows.where("line % 2 = 0"), rows.where("line % 2 = 1")], f"{folder}/in", stream)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("""
, ranked as (select *, row_number() over (partition by session_id, task_type order by line desc) as place from tasks)
select session_id, task_type, line, part, status from ranked where place = 1""")
def snapshot_then_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest tasks from a snapshot of the first lines and a stream of those that came after; of equal lines the first in the table."""
    folder = f"{shared_folder(spark)}/touchline/tail-{uuid.uuid4().hex}"
    columns = ["session_id", "task_type", "line", "part", "status"]
    rows = tasks(spark, sf_dir, placed=True).select(*columns, "file", "row")

    def stream():
        tail = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/turn=*")
        return windows.copy_stream(tail, f"{folder}/checkpoint", f"{folder}/out")

    windows.in_turns([rows.where("line = 3"), rows.where("line > 3")], f"{folder}/in", stream)
    order = [F.desc("line"), F.asc("file"), F.asc("row")]
    return windows.snapshot_then_tail(rows.where("line < 3"), spark.read.schema(rows.schema).parquet(f"{folder}/out"), ["session_id", "task_type"], order).select(columns)

"""Queries of laid-out frames, binned range joins and streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import matching
from touchline.plans.inputs import Registry, table, totals, tracks
from touchline.sources import frames
from touchline.sources.folders import cached, shared_folder
from touchline.streaming import stateful, windows

registry = Registry()
query = registry.query
SESSION, FRAME = ["session_id"], ["session_id", "frame"]
BUCKETS = 8


def laid_out(spark: SparkSession, sf_dir: str) -> str:
    """The path of the tracks laid out for scans, written once for each application and input."""
    name = "frames-" + uuid.uuid5(uuid.NAMESPACE_URL, sf_dir).hex
    return cached(spark, name, lambda path: frames.lay_out(tracks(spark, sf_dir), path, buckets=BUCKETS))


@query("select session_id, frame, mx from tracks where frame >= 12 and frame < 48 and (frame - 12) % 5 = 0")
def pruned_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame of a range, from the laid-out tracks."""
    return frames.scan(spark, laid_out(spark, sf_dir), 12, 48, 5).select(*FRAME, "mx")


@query("select session_id, frame, speed from tracks where session_id in (3, 17, 40) and frame < 30")
def pruned_session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frames of three sessions, from their buckets alone."""
    return frames.scan(spark, laid_out(spark, sf_dir), end=30, sessions=(3, 17, 40), buckets=BUCKETS).select(*FRAME, "speed")


@query("""
, asked as (
  select session_id, cast(s as integer) as start_frame, cast(least(s + 11 + s % 13, total_frames) as integer) as end_frame, s // 7 as number
  from (select session_id, total_frames, unnest(range(0, total_frames, 7)) as s from totals)),
ranked as (
  select t.session_id, t.frame, a.start_frame, a.end_frame, a.number, row_number() over (partition by t.session_id, t.frame order by a.start_frame, a.end_frame) as place
  from tracks t join asked a on a.session_id = t.session_id and t.frame >= a.start_frame and t.frame < a.end_frame)
select session_id, frame, start_frame, end_frame, number from ranked where place = 1""")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of many overlapping ranges that holds each frame."""
    starts = totals(spark, sf_dir).select("session_id", "total_frames", F.explode(F.sequence(F.lit(0), F.col("total_frames") - 1, F.lit(7))).alias("start_frame"))
    end = F.least(F.col("start_frame") + 11 + F.col("start_frame") % 13, F.col("total_frames"))
    asked = starts.select("session_id", "start_frame", end.alias("end_frame"), F.floor(F.col("start_frame") / 7).alias("number"))
    return matching.first_range(tracks(spark, sf_dir).select(*FRAME), asked, SESSION)


def stream_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/touchline/{name}-{uuid.uuid4().hex}"


@query("""
, asked as (select event_id as request, user_id as session_id, ts as asked_at from events where event_type = 'signup'),
ready as (select event_id as result, user_id as session_id, ts as ready_at from events where event_type = 'purchase')
select a.request, a.session_id, r.result from asked a left join ready r
  on r.session_id = a.session_id and r.ready_at >= a.asked_at and r.ready_at <= a.asked_at + interval 6 hour""")
def deferred_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that wait six hours for results of their session: two streams that come in three turns, results a turn behind.

    The last turn is a row of each stream far ahead, which moves both watermarks past all waits.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.percentile_approx(F.unix_micros("ts"), [0.35, 0.7])).first()[0]  # two numbers
    turn = F.when(F.unix_micros("ts") < low, 0).when(F.unix_micros("ts") < high, 1).otherwise(2)
    span = events.agg(F.max("ts") - F.min("ts")).first()[0]
    asked = events.where("event_type = 'signup'").select(F.col("event_id").alias("request"), F.col("user_id").alias("session_id"), F.col("ts").alias("asked_at"), turn.alias("part"))
    ready = events.where("event_type = 'purchase'").select(F.col("event_id").alias("result"), F.col("user_id").alias("session_id"), F.col("ts").alias("ready_at"), turn.alias("part"))
    end = F.expr("timestamp'2100-01-01'")
    none = F.lit(-1).cast("long")  # not null, as nulls are filtered before they reach a watermark
    folder = stream_folder(spark, "deferred")
    kinds = {"asked": asked.drop("part"), "ready": ready.drop("part")}

    def stream():
        left, right = (stateful.read_rows(spark, f"{folder}/{name}", rows.schema) for name, rows in kinds.items())
        late = f"{int(span.total_seconds()) + 1} seconds"
        found = stateful.deferred_join(left, right, "session_id", F.expr("interval 6 hours"), late).select("request", "session_id", "result")
        return windows.copy_stream(found, f"{folder}/checkpoint", f"{folder}/out")

    for k in range(4):
        asked.where(f"part = {k}").drop("part").unionByName(_last(kinds["asked"], none, end, k)).write.parquet(f"{folder}/asked/turn={k}")
        ready.where(f"part = {k - 1}").drop("part").unionByName(_last(kinds["ready"], none, end, k)).write.parquet(f"{folder}/ready/turn={k}")
        stream().awaitTermination()
    return spark.read.schema("request long, session_id long, result long").parquet(f"{folder}/out").where("request >= 0")


def _last(rows: DataFrame, none, end, turn: int) -> DataFrame:
    """A row of no session far ahead, in the last turn."""
    number, _, at = rows.columns
    return rows.sparkSession.range(1 if turn == 3 else 0).select(none.alias(number), none.alias("session_id"), end.alias(at)).select(*rows.columns)


@query()
def kalman_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered positions of every session from a stream that gets its frames in three turns."""
    known = F.col("track_id") % 4 == 0
    measures = {"cx": F.col("mx"), "cy": F.col("my"), "aspect": F.lit(0.4), "h": F.lit(100.0)}
    at = F.timestamp_seconds(F.col("frame") * 60 + 1_000_000_000).alias("at")
    rows = tracks(spark, sf_dir).select(*FRAME, at, *(F.when(known, v).cast("double").alias(k) for k, v in measures.items()))
    third = totals(spark, sf_dir).withColumn("third", F.greatest(F.floor(F.col("total_frames") / 3), F.lit(1))).select("session_id", "third")
    turn = F.least(F.floor(F.col("frame") / F.col("third")), F.lit(2))
    dealt = rows.join(third, "session_id").withColumn("part", turn).drop("third")
    folder = stream_folder(spark, "kalman")
    groups = max(8, totals(spark, sf_dir).count() // 64)

    def stream():
        measures = stateful.read_rows(spark, f"{folder}/in", rows.schema)
        return stateful.kalman_stream(measures, "session_id", f"{folder}/checkpoint", f"{folder}/out", groups=groups)

    windows.in_turns([dealt.where(f"part = {k}").select(*rows.columns) for k in range(3)], f"{folder}/in", stream)
    return spark.read.parquet(f"{folder}/out")

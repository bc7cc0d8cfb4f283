"""Queries of detections, targets, the camera, segments to plan, and feature results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import geometry, text
from touchline.operators import detections, exports, features, jobs, masks, play, scenes, series, targets
from touchline.plans.inputs import NOW, Registry, pitch, segments, sessions, table, tasks, totals, tracks
from touchline.schemas import MATCH_TYPES
from touchline.sources.folders import cached, shared_folder

registry = Registry()
query = registry.query
SESSION, FRAME = ["session_id"], ["session_id", "frame"]

DETECTED = """
, det as (
  select session_id, frame, track_id as idx, cast(x % 997 as double) / 997 as conf, x % 1900 as x1, y % 1000 as y1, x % 1900 + y % 60 as x2, y % 1000 + x % 90 as y2,
         case when track_id = 0 then 'Goalkeeper' when track_id = 21 then 'referee' when track_id = 10 then 'ball' else 'player' end as cls
  from pitch)"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with boxes in pixels, made of the pitch positions."""
    cls = F.when(F.col("track_id") == 0, "Goalkeeper").when(F.col("track_id") == 21, "referee").when(F.col("track_id") == 10, "ball").otherwise("player")
    x, y = F.col("x"), F.col("y")
    return pitch(spark, sf_dir).select(
        *FRAME, F.col("track_id").alias("idx"), (x % 997 / F.lit(997.0)).alias("conf"), (x % 1900).alias("x1"), (y % 1000).alias("y1"),
        (x % 1900 + y % 60).alias("x2"), (y % 1000 + x % 90).alias("y2"), cls.alias("cls"),
    )


@query("select session_id, frame, track_id, speed from tracks where frame in (3, 5, 7, 40)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a list of indices, repeated and negative ones among them."""
    wanted = spark.createDataFrame([(k,) for k in (5, 3, 3, -1, 40, 7)], "frame int").where("frame >= 0").distinct()
    return tracks(spark, sf_dir).join(F.broadcast(wanted), "frame", "left_semi").select(*FRAME, "track_id", "speed")


@query("""
select session_id, 100 + frame * 10 as frame, 1 as obj, cast(mx as double) / 0.5 as x, cast(my as double) / 0.5 as y, (mx % 50) / 0.5 as w, (my % 40) / 0.5 as h
from tracks where track_id % 11 <> 0 and mx % 50 > 0 and my % 40 > 0""")
def bbox_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as text lines, every eleventh of them too short."""
    whole = F.concat_ws(",", "frame", F.lit(1), "mx", "my", F.col("mx") % 50, F.col("my") % 40)
    lines = tracks(spark, sf_dir).select("session_id", F.when(F.col("track_id") % 11 == 0, F.concat_ws(",", "frame", F.lit(1), "mx")).otherwise(whole).alias("value"))
    return targets.parse_boxes(lines, SESSION, F.lit(100), 10, 0.5)


@query("select session_id, frame, mx as x1, my as y1, mx + mx % 50 as x2, my + my % 40 as y2 from tracks")
def prompt_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", "mx", "my", F.col("mx") % 50, F.col("my") % 40)
    return tracks(spark, sf_dir).select(*FRAME, targets.parse_prompt(line).alias("box")).select(*FRAME, "box.*")


@query("select session_id, count(*) as frames, max(speed) as top from tracks group by session_id")
def analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis table written as Parquet, which appears whole or not at all, and from then on read from its cache."""
    name = "analysis-" + uuid.uuid5(uuid.NAMESPACE_URL, sf_dir).hex
    path = cached(spark, name, lambda own: tracks(spark, sf_dir).write.parquet(own))
    return spark.read.parquet(path).groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.max("speed").alias("top"))


@query("""
, probe as (select session_id, total_frames, case when session_id % 3 = 0 then 0 when session_id % 3 = 1 then 30 end as fps,
                   case when session_id % 2 = 0 then total_frames else 0 end as counted, total_frames / 25 as seconds from totals)
select session_id, coalesce(nullif(fps, 0), 25) as fps, cast(case when counted > 0 then counted else floor(seconds * coalesce(nullif(fps, 0), 25)) end as bigint) as frames from probe""")
def probed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and length of a video, with what stands in where the container does not say."""
    fps = F.when(F.col("session_id") % 3 == 0, 0).when(F.col("session_id") % 3 == 1, 30)
    probe = totals(spark, sf_dir).select(
        "session_id", F.coalesce(F.nullif(fps, F.lit(0)), F.lit(25)).alias("fps"), F.when(F.col("session_id") % 2 == 0, F.col("total_frames")).otherwise(0).alias("counted"), (F.col("total_frames") / 25).alias("seconds")
    )
    frames = F.when(F.col("counted") > 0, F.col("counted")).otherwise(F.floor(F.col("seconds") * F.col("fps")))
    return probe.select("session_id", "fps", frames.cast("long").alias("frames"))


@query("select id, status from sessions order by (id = 33) desc, id limit 1")
def default_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The video asked for, or the first there is."""
    return sessions(spark, sf_dir).orderBy((F.col("id") == 33).desc(), "id").limit(1).select("id", "status")


@query(f"""{DETECTED}
select session_id, frame, idx, id, 'player' as cls from (select *, row_number() over (partition by session_id, frame order by conf desc, idx) as id from det)
where cls in ('player', 'Goalkeeper')""")
def numbered_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.numbered_players(_detected(spark, sf_dir), FRAME).select(*FRAME, "idx", "id", "cls")


@query(f"""{DETECTED}
, named as (select *, case when session_id % 2 = 0 then lower(cls) else case when cls in ('referee', 'ball') then cls else 'person' end end as kind from det),
picked as (select *, max(case when kind in ('player', 'goalkeeper') then 1 else 0 end) over (partition by session_id, frame) as got from named)
select session_id, frame, idx, row_number() over (partition by session_id, frame order by conf desc, idx) as id from picked
where kind in ('player', 'goalkeeper') or (got = 0 and kind not in ('referee', 'ball'))""")
def detect_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = F.when(F.col("cls").isin("referee", "ball"), F.col("cls")).otherwise("person")
    named = _detected(spark, sf_dir).withColumn("cls", F.when(F.col("session_id") % 2 == 0, F.lower("cls")).otherwise(person))
    return detections.post_filter(named, FRAME).select(*FRAME, "idx", "id")


@query(f"""{DETECTED}
select session_id, frame, idx, x1 as x, y1 as y, px, py from det join (values (1, 0, 0), (2, 60, 0), (3, 120, 70)) as p(idx, px, py) using (idx)
where conf > 0.65 and not (x1 = 0 and y1 = 0)""")
def keypoints_on_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(1, 0, 0), (2, 60, 0), (3, 120, 70)], "idx long, px int, py int")
    points = _detected(spark, sf_dir).select(*FRAME, "idx", "conf", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return detections.on_pitch(detections.key_points(points), known, "idx").select(*FRAME, "idx", "x", "y", "px", "py")


@query(f"{DETECTED} select session_id, frame, idx, case when cls = 'ball' then (y1 + y2) // 2 else y2 end as y, (x1 + x2) // 2 as x from det where x2 > x1 and y2 > y1")
def valid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    found = _detected(spark, sf_dir).where(geometry.valid_box(*box)).withColumn("at", geometry.position(F.col("cls"), *box))
    return found.select(*FRAME, "idx", F.col("at.x").cast("long").alias("x"), F.col("at.y").cast("long").alias("y"))


@query(f"{DETECTED} select session_id, frame, idx, x1 * 0.5 as x, y1 * 0.5 as y, (x2 - x1) * 0.5 as w, (y2 - y1) * 0.5 as h from det where (x2 - x1) * 0.5 >= 8 and (y2 - y1) * 0.5 >= 8")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = [F.col(c) * 0.5 for c in ("x1", "y1", "x2", "y2")]
    found = _detected(spark, sf_dir).withColumn("box", geometry.corners_to_size(*half)).select(*FRAME, "idx", "box.*")
    return found.where(geometry.large_enough(F.col("w"), F.col("h")))


@query(f"""{DETECTED}
select session_id, frame, idx, x1 + 100 as x1, y1 + 50 as y1, x2 + 100 as x2, y2 + 50 as y2 from det
where conf > 0.3 and conf + 0.1 >= 0.5
  and not (abs(x1 - 100) <= 20 and x1 > 20) and not (abs(y1 - 50) <= 20 and y1 > 20) and not (abs(x2 - 1600) <= 20 and 1920 - x2 > 20) and not (abs(y2 - 900) <= 20 and 1080 - y2 > 20)""")
def masks_of_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a crop filtered by quality and by its edge, then moved into the image."""
    crop = {"crop_x1": 100, "crop_y1": 50, "crop_x2": 1600, "crop_y2": 900, "image_w": 1920, "image_h": 1080}
    named = _detected(spark, sf_dir).withColumns({"pred_iou": F.col("conf"), "stability": F.col("conf") + 0.1, **{k: F.lit(v) for k, v in crop.items()}})
    return detections.uncrop(detections.crop_filter(named, 0.3, 0.5, 20)).select(*FRAME, "idx", "x1", "y1", "x2", "y2")


@query("""
select session_id, frame, count(*) filter (x > 6500) as inner_pixels, count(*) filter (x > 5500) as outer_pixels,
       coalesce(count(*) filter (x > 6500) / nullif(count(*) filter (x > 5500), 0), 0) as stability from pitch group by all""")
def mask_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.stability(pitch(spark, sf_dir).withColumn("value", F.col("x")), FRAME, 6000, 500)


@query("""
, dims as (select session_id, 100 + total_frames % 50 as w, 80 + total_frames % 30 as h from totals),
layers as (select *, unnest([0, 1, 2]) as layer from dims), sides as (select *, cast(pow(2, layer) as integer) as side from layers),
lap as (select *, case when layer = 0 then 0 else floor(0.25 * least(w, h) * (2 / side)) end as shared from sides),
cut as (select *, ceil((shared * (side - 1) + w) / side) as cw, ceil((shared * (side - 1) + h) / side) as ch from lap),
cells as (select *, unnest(range(side)) as i from cut), grid as (select *, unnest(range(side)) as j from cells)
select session_id, w, h, layer, cast((cw - shared) * i as integer) as x1, cast((ch - shared) * j as integer) as y1,
       cast(least((cw - shared) * i + cw, w) as integer) as x2, cast(least((ch - shared) * j + ch, h) as integer) as y2 from grid""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = totals(spark, sf_dir).select("session_id", (F.col("total_frames") % 50 + 100).alias("w"), (F.col("total_frames") % 30 + 80).alias("h"))
    return detections.crop_boxes(images, 2, 0.25)


@query("select session_id, frame, 10 + cast(trunc(mx / 12000 * 600) as integer) as px, 10 + cast(trunc(my / 7000 * 350) as integer) as py from tracks")
def pitch_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = geometry.pitch_pixel(F.col("mx"), 12000, 600, 10), geometry.pitch_pixel(F.col("my"), 7000, 350, 10)
    return tracks(spark, sf_dir).select(*FRAME, px.alias("px"), py.alias("py"))


@query("""
, marks as (select session_id, s as start, case when s = 10 then 30 end as "end" from (select session_id, unnest([10, 40, 55]) as s from totals)),
scaled as (select session_id, cast(round_even(start * r, 0) as integer) as start, cast(round_even("end" * r, 0) as integer) as "end", total_frames
           from (select m.*, t.total_frames, case when session_id % 2 = 0 then 1.25 else 1 end as r from marks m join totals t using (session_id))),
ends as (select *, least(coalesce("end", lead(start) over (partition by session_id order by start), total_frames), total_frames) as end_frame from scaled)
select session_id, greatest(start, 0) as start_frame, end_frame from ends where end_frame - greatest(start, 0) > 1""")
def planned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from marks of a client whose clock runs at another rate, or does not say."""
    marks = totals(spark, sf_dir).select("session_id", F.explode(F.array(F.lit(10), F.lit(40), F.lit(55))).alias("start"))
    marks = marks.withColumn("end", F.when(F.col("start") == 10, 30))
    client = F.when(F.col("session_id") % 2 == 0, F.lit(20.0))
    return targets.planned_segments(marks, totals(spark, sf_dir), SESSION, F.lit(25.0), client, 1)


@query("""
, moved as (select session_id, type, start_frame + 7 as start_frame, end_frame - 40 as end_frame, total_frames from segments join totals using (session_id)),
near as (select *, coalesce(lag(end_frame) over w, 0) as low, coalesce(lead(start_frame) over w, total_frames) as high from moved window w as (partition by session_id order by start_frame)),
held as (select *, greatest(low, least(start_frame, high - 10)) as new_start from near)
select session_id, type, new_start, least(high, greatest(end_frame, new_start + 10)) as new_end, least(high, greatest(end_frame, new_start + 10)) - new_start >= 10 as valid from held""")
def period_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited periods held between their neighbours, and whether each has the least length."""
    moved = segments(spark, sf_dir).withColumns({"start_frame": F.col("start_frame") + 7, "end_frame": F.col("end_frame") - 40}).join(totals(spark, sf_dir), SESSION)
    edited = targets.period_edit(moved, SESSION, 10, "total_frames")
    return edited.select("session_id", "type", "new_start", "new_end", (F.col("new_end") - F.col("new_start") >= 10).alias("valid"))


@query("""
, samples as (select session_id, frame, mx, my, track_id from tracks where frame % 10 = 0 union all select session_id, frame, mx + 5, my + 5, track_id + 1000000000 from tracks where frame % 20 = 0),
best as (select session_id, frame, max_by(mx, track_id) as x, max_by(my, track_id) as y from samples group by all),
ends as (select session_id, max(frame) as last from best group by all),
grid as (select session_id, unnest(range(0, last + 1)) as frame from ends),
near as (select session_id, frame, frame // 10 * 10 as lo, case when frame % 10 = 0 then frame else frame // 10 * 10 + 10 end as hi from grid)
select n.session_id, cast(n.frame as integer) as frame, round(case when lo = hi then a.x else a.x + (b.x - a.x) * (n.frame - lo) / 10 end, 4) as x,
       round(case when lo = hi then a.y else a.y + (b.y - a.y) * (n.frame - lo) / 10 end, 4) as y
from near n join best a on a.session_id = n.session_id and a.frame = lo join best b on b.session_id = n.session_id and b.frame = hi""")
def dense_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial outputs put together, the later version winning, and made dense."""
    own = tracks(spark, sf_dir)
    first = own.where("frame % 10 = 0").select(*FRAME, F.col("mx").cast("double").alias("x"), F.col("my").cast("double").alias("y"), F.col("track_id").alias("version"))
    again = own.where("frame % 20 = 0").select(*FRAME, (F.col("mx") + 5).cast("double").alias("x"), (F.col("my") + 5).cast("double").alias("y"), (F.col("track_id") + 1000000000).alias("version"))
    found = targets.dense_target(first.union(again), SESSION, "version", ["x", "y"])
    return found.select(*FRAME, F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


CAMERA = """
, moved as (select session_id, frame, track_id as point, x % 17 - 8 as dx, y % 13 - 6 as dy from pitch),
ranked as (select *, row_number() over (partition by session_id, frame order by sqrt(cast(dx * dx + dy * dy as double)) desc, point) as place from moved),
camera as (select session_id, frame, case when dx * dx + dy * dy > 100 then dx else 0 end as dx, case when dx * dx + dy * dy > 100 then dy else 0 end as dy from ranked where place = 1)"""


def _camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = pitch(spark, sf_dir).select(*FRAME, F.col("track_id").alias("point"), "x", "y", (F.col("x") + (F.col("x") % 17 - 8)).alias("new_x"), (F.col("y") + (F.col("y") % 13 - 6)).alias("new_y"))
    return targets.camera_motion(flow, FRAME)


@query(CAMERA.replace("> 100", "> 25") + " select * from camera")
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _camera(spark, sf_dir)


@query(CAMERA.replace("> 100", "> 25") + """
select p.session_id, p.frame, p.track_id, p.x - coalesce(c.dx, 0) as adjusted_x, p.y - coalesce(c.dy, 0) as adjusted_y
from pitch p left join (select * from camera where frame % 2 = 0) c on p.session_id = c.session_id and p.frame = c.frame""")
def camera_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _camera(spark, sf_dir).where("frame % 2 = 0")
    return targets.camera_adjusted(pitch(spark, sf_dir), some, SESSION).select(*FRAME, "track_id", "adjusted_x", "adjusted_y")


@query(CAMERA.replace("> 100", "> 25") + " select session_id, frame, dx * 3 as dx, dy * 3 as dy from camera where frame % 20 = 0 or sqrt(cast(dx * dx + dy * dy as double)) * 3 > 15")
def motion_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = _camera(spark, sf_dir).withColumns({c: F.col(c) * 3 for c in ("dx", "dy")})
    return targets.motion_samples(tripled, 20)


@query(CAMERA.replace("> 100", "> 25") + """
, ends as (select session_id, max(frame) + 1 as total_frames from pitch group by all),
grid as (select session_id, unnest(range(0, total_frames)) as frame, total_frames from ends),
near as (select *, frame // 3 * 3 as lo, case when frame % 3 = 0 then frame else frame // 3 * 3 + 3 end as hi from grid),
filled as (
  select n.session_id, n.frame, case when lo = hi or b.dx is null then a.dx else a.dx + (b.dx - a.dx) * (n.frame - lo) / 3 end as dx,
         case when lo = hi or b.dy is null then a.dy else a.dy + (b.dy - a.dy) * (n.frame - lo) / 3 end as dy
  from near n join camera a on a.session_id = n.session_id and a.frame = lo left join camera b on b.session_id = n.session_id and b.frame = hi)
select session_id, cast(frame as integer) as frame, round(avg(dx) over w, 4) + 0.0 as dx, round(avg(dy) over w, 4) + 0.0 as dy
from filled window w as (partition by session_id order by frame rows between 2 preceding and 2 following)""")
def camera_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera motion of every third frame, filled and smoothed."""
    ends = pitch(spark, sf_dir).groupBy("session_id").agg((F.max("frame").cast("int") + 1).alias("total_frames"))
    some = _camera(spark, sf_dir).where("frame % 3 = 0").withColumns({"frame": F.col("frame").cast("int"), "dx": F.col("dx").cast("double"), "dy": F.col("dy").cast("double")})
    found = targets.dense_camera(some, ends, SESSION)
    return found.select(*FRAME, *((F.round(c, 4) + 0.0).alias(c) for c in ("dx", "dy")))  # no negative zero


@query("""
, m as (select *, quantile_cont(mx, 0.5) over (partition by session_id order by frame rows between 7 preceding and 7 following) as m15,
               quantile_cont(mx, 0.5) over (partition by session_id order by frame rows between 3 preceding and 3 following) as m7,
               quantile_cont(mx, 0.5) over (partition by session_id order by frame rows between 2 preceding and 2 following) as m5 from tracks),
a as (select *, avg(m15) over (partition by session_id order by frame rows between 7 preceding and 7 following) as a15,
             avg(m7) over (partition by session_id order by frame rows between 3 preceding and 3 following) as a7,
             avg(m5) over (partition by session_id order by frame rows between 2 preceding and 2 following) as a5 from m)
select session_id, frame, round(case when speed < 10 then a15 when speed > 40 then a5 else a7 end, 4) as smooth_mx from a""")
def smoothed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.smoothed(tracks(spark, sf_dir), SESSION, ["mx"], "speed", 10, 40)
    return found.select(*FRAME, F.round("smooth_mx", 4).alias("smooth_mx"))


@query("select session_id, frame, case when track_id % 3 = 0 then my / 100 when track_id % 3 = 1 then mx / 100 else mx / 100 end as x from tracks where not (track_id % 3 = 2 and mx < 0)")
def position_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NaN minimap position falls back to the transformed one."""
    first = F.when(F.col("track_id") % 3 == 0, F.lit(float("nan"))).when(F.col("track_id") % 3 == 1, F.col("mx") / 100)
    fallback = F.when(F.col("track_id") % 3 == 0, F.col("my") / 100).otherwise(F.col("mx") / 100)
    return tracks(spark, sf_dir).select(*FRAME, targets.position_or(first, fallback).alias("x"))


@query("select session_id, type, end_frame - start_frame >= case when session_id % 2 = 0 then 75 else 20 end as long_enough from segments")
def period_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.when(F.col("session_id") % 2 == 0, 75).otherwise(20)
    return segments(spark, sf_dir).select("session_id", "type", scenes.long_enough(least).alias("long_enough"))


@query("select distinct session_id, task_type from tasks where status = 'running'")
def busy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session and type of tasks that a new one of the type would repeat."""
    return jobs.busy(tasks(spark, sf_dir), ["session_id", "task_type"], ("queued", "running"))


@query("select session_id, line, part from tasks where part is not null and status is not null and status <> ''")
def truthy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.truthy(tasks(spark, sf_dir), ["part", "status"]).select("session_id", "line", "part")


@query("select l_orderkey as session_id, l_linenumber as line, o_custkey as user_id from lineitem join orders on split_part(cast(l_orderkey as varchar) || '/part/' || l_linenumber, '/', 1) = cast(o_orderkey as varchar)")
def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects with the session that their name starts with."""
    objects = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.lit("part"), F.col("l_linenumber").cast("string")).alias("name"))
    found = jobs.objects_of_sessions(objects, sessions(spark, sf_dir).select("id", "user_id"))
    return found.select(F.col("id").alias("session_id"), F.split_part("name", F.lit("/"), F.lit(3)).cast("int").alias("line"), "user_id")


@query("""
, first as (select * from pitch where frame % 10 = 0), other as (select * from pitch where frame % 10 = 5 and track_id % 4 <> 0)
select a.session_id, a.frame, a.track_id as id, a.x + (coalesce(b.x, a.x) - a.x) * 0.4 as x, a.y + (coalesce(b.y, a.y) - a.y) * 0.4 as y
from first a left join other b on a.session_id = b.session_id and a.track_id = b.track_id and b.frame = a.frame + 5""")
def held_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pitch(spark, sf_dir).select(*FRAME, F.col("track_id").alias("id"), "x", "y")
    after = own.where("frame % 10 = 5 and id % 4 <> 0").withColumn("frame", F.col("frame") - 5)
    return targets.held_objects(own.where("frame % 10 = 0"), after, FRAME, 0.4)


@query("""
, turned as (select session_id, track_id, case when team = 1 then x else 12000 - x end as x from pitch),
counted as (select session_id, track_id, count(*) filter (x < 4000) as defensive, count(*) filter (x >= 4000 and x <= 8000) as middle, count(*) filter (x > 8000) as attacking from turned group by all)
select *, defensive * 100.0 / (defensive + middle + attacking) as defensive_pct, middle * 100.0 / (defensive + middle + attacking) as middle_pct,
       attacking * 100.0 / (defensive + middle + attacking) as attacking_pct from counted""")
def thirds_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = pitch(spark, sf_dir).withColumn("towards_right", F.col("team") == 1)
    return features.thirds_share(play.pitch_thirds(positions, ["session_id", "track_id"], 12000))


@query("""
, cells as (select session_id, cast(floor(x / 1000) as bigint) as cell_x, cast(floor(y / 1000) as bigint) as cell_y, count(*) as n from pitch group by all),
shifts as (select * from (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy))
select session_id, cell_x + dx as cell_x, cell_y + dy as cell_y, sum(n * (2 - abs(dx)) * (2 - abs(dy)) / 16.0) as density from cells, shifts group by all""")
def heat_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.heat(play.heat_histogram(pitch(spark, sf_dir), SESSION, 1000), SESSION)


@query("""
select session_id, sum(case when type <> 'halftime' then end_frame - start_frame else 0 end) / 25 as match_s,
       sum(case when type = 'halftime' then end_frame - start_frame else 0 end) / 25 as skipped_s from segments group by all""")
def match_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.match_time(segments(spark, sf_dir), SESSION, 25.0, MATCH_TYPES)


@query("select session_id, greatest(20.0, max(case when speed between 0.5 and 34 then speed end)) as scale from tracks group by all")
def speed_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tracks(spark, sf_dir).withColumn("max_speed", play.clean_speed(F.col("speed")))
    return features.speed_scale(clean, SESSION)


SCORED = """
, scored as (select session_id, track_id as obj, x % 50 as inter_px, x % 50 + y % 30 as union_px, y % 20 as hit_px, y % 20 + x % 7 as found_px, y % 20 + x % 5 as wanted_px from pitch),
judged as (
  select session_id, obj, avg(case when union_px > 0 then inter_px / union_px else 1 end) * 100 as j,
         avg(case when found_px + wanted_px > 0 then 2 * hit_px / (found_px + wanted_px) else 1 end) * 100 as f from scored group by all)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return pitch(spark, sf_dir).select(
        "session_id", F.col("track_id").alias("obj"), (x % 50).alias("inter_px"), (x % 50 + y % 30).alias("union_px"), (y % 20).alias("hit_px"), (y % 20 + x % 7).alias("found_px"), (y % 20 + x % 5).alias("wanted_px")
    )


@query(SCORED + " select session_id, obj, round(j, 4) as j, round(f, 4) as f, round((j + f) / 2, 4) as jf from judged")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.evaluate(_scored(spark, sf_dir), ["session_id", "obj"])
    return found.select("session_id", "obj", *(F.round(c, 4).alias(c) for c in ("j", "f", "jf")))


@query(SCORED + " select round(avg(j), 3) as j, round(avg(f), 3) as f, round((avg(j) + avg(f)) / 2, 3) as jf, count(*) as objects from judged")
def evaluation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all objects written as CSV, read again, and their global means."""
    path = f"{shared_folder(spark)}/touchline/scores-{uuid.uuid4().hex}"
    features.evaluate(_scored(spark, sf_dir), ["session_id", "obj"]).write.csv(path, header=True)
    rows = spark.read.csv(path, header=True, schema="session_id long, obj long, j double, f double, jf double")
    return rows.agg(F.round(F.avg("j"), 3).alias("j"), F.round(F.avg("f"), 3).alias("f"), F.round((F.avg("j") + F.avg("f")) / 2, 3).alias("jf"), F.count(F.lit(1)).alias("objects"))


@query(SCORED + " select session_id, string_agg(obj || ':' || cast(round(j * 10) as integer), ',' order by obj) as objects from judged group by all")
def scores_of_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = features.evaluate(_scored(spark, sf_dir), ["session_id", "obj"]).withColumn("j", F.round(F.col("j") * 10).cast("int"))
    found = features.per_video(judged, "session_id", "obj", "j")
    return found.select("session_id", F.expr("array_join(transform(map_entries(objects), e -> concat(e.key, ':', e.value)), ',')").alias("objects"))


@query("""
select session_id, round(count(*) filter (team = 1) * 100.0::double / count(*), 1) as team1_pct, round(count(*) filter (team = 2) * 100.0::double / count(*), 1) as team2_pct,
       round(count(*) filter (team = 0) * 100.0::double / count(*), 1) as neutral_pct, coalesce(max(case when team = 1 and mx % 2 = 0 then '#' || mx end), '#3498db') as team1_color,
       coalesce(max(case when team = 2 and mx % 2 = 0 then '#' || mx end), '#e74c3c') as team2_color,
       round(count(*) filter (team = 1) / 25.0::double, 1) as team1_seconds, round(count(*) filter (team = 2) / 25.0::double, 1) as team2_seconds
from tracks group by all""")
def feature_possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the possession feature, colours being known to some teams."""
    own = tracks(spark, sf_dir)
    colours = own.where("mx % 2 = 0").select("session_id", "team", F.concat(F.lit("#"), F.col("mx")).alias("hex"))
    return features.FEATURES["possession"](own, SESSION, 25.0, colours)


@query("""
, played as (select session_id, frame, case when mx % 10 = 0 then 0 else speed end as speed, my % 3 <> 0 as located from tracks),
marked as (select *, frame - row_number() over (partition by session_id order by frame) as run from played where speed >= 25),
found as (select session_id, (max(frame) - min(frame)) / 1.0::double as d from marked group by session_id, run having count(*) >= 2 and count(*) filter (located) >= 2)
select p.session_id, coalesce(any_value(n), 0) as sprint_count, coalesce(any_value(a), 0) as avg_duration_s, coalesce(any_value(m), 0) as max_duration_s, round(max(speed), 1) as max_speed_kmh
from played p left join (select session_id, count(*) as n, round(avg(d), 2) as a, round(max(d), 2) as m from found group by all) using (session_id) group by p.session_id""")
def feature_sprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the sprint feature: frames without a match have no speed, some have no position, and sessions no sprint."""
    samples = tracks(spark, sf_dir).withColumn("speed", F.when(F.col("mx") % 10 == 0, F.lit(None)).otherwise(F.col("speed")))
    return features.FEATURES["sprint_analysis"](samples, SESSION, 1.0, 25.0, 2.0, F.col("my") % 3 != 0)


@query("""
, own as (select session_id, frame, x, team from pitch where track_id = 3),
sides as (select session_id, coalesce(cast(floor(quantile_cont(team, 0.5) filter (team <> 0)) as integer), 1) as tracked_team from own group by all),
xs as (select p.session_id, p.frame, list_sort(list(p.x::double)) as v from pitch p join sides using (session_id)
       where p.team = case when tracked_team = 1 then 2 else 1 end group by all),
lines as (select o.session_id, o.frame, o.x, case when o.x < list_avg(v) then list_avg(v[1:4]) else list_avg(v[-4:]) end as line_x from own o join xs using (session_id, frame)),
beyond as (select *, frame - row_number() over (partition by session_id order by frame) as run from lines where x > line_x),
events as (select session_id from beyond group by session_id, run having count(*) >= 3)
select session_id, tracked_team, (select count(*) from events e where e.session_id = s.session_id) as penetration_count, case when tracked_team = 1 then 2 else 1 end as opponent_team from sides s""")
def feature_defensive_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the defensive line feature: the line of the opponents that the tracked player faces in each frame."""
    players = pitch(spark, sf_dir)
    return features.FEATURES["defensive_line"](players.where("track_id = 3"), players, SESSION)


@query("""
select session_id, frame, case when speed > 60 then 0 else speed end as speed,
       coalesce(last_value(case when frame % 4 = 1 then mx / 100 end ignore nulls) over (partition by session_id order by frame rows unbounded preceding), 0) as distance,
       case when speed > 60 then 'walk' when speed >= 24 then 'sprint' when speed >= 7 then 'run' else 'walk' end as zone from tracks""")
def feature_speed_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tracks(spark, sf_dir).select(*FRAME, F.when(F.col("speed") > 60, F.lit(float("nan"))).otherwise(F.col("speed")).alias("speed"), F.when(F.col("frame") % 4 == 1, F.col("mx") / 100).alias("distance"))
    return features.FEATURES["speed_chart"](samples, SESSION)


@query("select session_id, '{\"frames\":' || count(*) || ',\"team1_frames\":' || count(*) filter (team = 1) || '}' as payload from tracks group by all")
def summary_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = play.possession_share(tracks(spark, sf_dir), SESSION).select("session_id", "frames", "team1_frames")
    return features.FEATURES["ai_summary"](stats, SESSION)


@query("""
, shares as (select session_id, cast(count(*) filter (team = 1) as double) * 100 / count(*) as a, cast(count(*) filter (team = 2) as double) * 100 / count(*) as b from tracks group by all)
select session_id, slice, round(share, 4) as share from (
  select session_id, 'team1' as slice, a as share from shares union all select session_id, 'team2', b from shares union all select session_id, 'neutral', greatest(0, 100 - a - b) from shares) where share > 0""")
def possession_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = play.possession_share(tracks(spark, sf_dir), SESSION).withColumn("neutral_pct", F.lit(None).cast("double"))
    return features.pie(shares, SESSION).withColumn("share", F.round("share", 4)).where("share > 0")


@query("select session_id, least(1.0, 60.0 / (total_frames / 25)) as fps from totals")
def summary_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir).select("session_id", features.frame_rate(F.col("total_frames") / 25).alias("fps"))


@query("""
select session_id, quantile_cont(x, 0.5) as line_x, (select count(*) from (select session_id as s, row_number() over (partition by session_id order by frame) as n from pitch where track_id = 3) q where q.s = p.session_id and n % 3 = 1) as path_points
from pitch p where track_id = 3 group by session_id""")
def drawn_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median line, and how many points of a path thinned to every third are drawn."""
    own = pitch(spark, sf_dir).where("track_id = 3").withColumn("n", F.row_number().over(series.ordered(SESSION, "frame")))
    return own.groupBy("session_id").agg(F.percentile("x", 0.5).alias("line_x"), F.count_if(F.col("n") % 3 == 1).alias("path_points"))


@query("""
, w as (select session_id, total_frames // 3 as start_frame, total_frames as n from totals)
select session_id, cast(row_number() over (partition by session_id order by back, case when back = 0 then f else -f end) - 1 as integer) as step, cast(f as integer) as frame
from (select session_id, unnest(range(start_frame, n)) as f, 0 as back from w union all select session_id, unnest(range(0, start_frame)), 1 from w)""")
def propagation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = totals(spark, sf_dir).select("session_id", F.floor(F.col("total_frames") / 3).cast("int").alias("start_frame"), "total_frames")
    return targets.propagation_order(runs).select("session_id", "step", "frame")


@query("select session_id, frame, copy from (select session_id, frame, unnest(range(1, 2 + case when (mx % 100) / 100 < 0.5 then 1 else 0 end)) as copy from tracks)")
def repeat_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows repeated one and a half times on average."""
    found = targets.repeated(tracks(spark, sf_dir), F.lit(1.5), F.col("mx") % 100 / 100)
    return found.select(*FRAME, F.col("copy").cast("long").alias("copy"))


@query("select distinct frame from tracks where frame % 7 = 0 or frame % 11 = 0")
def union_of_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tracks(spark, sf_dir).select("frame")
    return own.where("frame % 7 = 0").union(own.where("frame % 11 = 0")).distinct().orderBy("frame")


@query("select session_id, row_number() over (partition by t.session_id order by frame) - 1 as position, t.frame, t.team from tracks t join segments s using (session_id) where frame >= start_frame and frame < end_frame and type <> 'halftime'")
def joined_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control series of all match ranges, put together."""
    played = segments(spark, sf_dir).where(F.col("type").isin(*MATCH_TYPES))
    met = tracks(spark, sf_dir).join(played, SESSION).where("frame >= start_frame and frame < end_frame")
    return met.select("session_id", (F.row_number().over(series.ordered(SESSION, "frame")) - 1).alias("position"), "frame", "team")


@query("select id, ntile(4) over (order by id) as part from sessions")
def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of all sessions split into four parts of consecutive ids, as equal as can be."""
    return exports.equal_parts(sessions(spark, sf_dir).select("id"), "id", 4)


@query("""
, s as (select session_id, frame, speed, cast(sum(mx) over (partition by session_id order by frame) / 100.0::double as double) as distance from tracks)
select g.session_id, g.start_frame, replace(g.type, '_', ' ') as name, coalesce(max(distance) - min(distance), 0) as distance_m,
       round(avg(case when speed between 0.5 and 34 then speed end), 6) as avg_speed_kmh, max(case when speed between 0.5 and 34 then speed end) as max_speed_kmh
from segments g left join s on s.session_id = g.session_id and s.frame >= g.start_frame and s.frame < g.end_frame group by g.session_id, g.start_frame, g.type""")
def period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, mean and largest speed of each period, as the dashboard shows them."""
    upto = series.ordered(SESSION, "frame").rowsBetween(Window.unboundedPreceding, 0)
    samples = tracks(spark, sf_dir).withColumn("distance", F.sum("mx").over(upto) / 100.0)
    found = features.period_series(samples, segments(spark, sf_dir), SESSION)
    return found.withColumn("avg_speed_kmh", F.round("avg_speed_kmh", 6))


@query("""
, v as (select session_id, total_frames * 50 as n from totals),
r as (select *, least(1.0::double, 60.0::double / greatest(n / 25.0::double, 1.0::double)) as rate from v),
t as (select *, unnest(range(0, least(60, greatest(1, cast(round(n / 25.0::double * rate) as integer))))) as nth from r)
select session_id, cast(nth as integer) as nth, cast(least(floor(nth / rate * 25.0::double + 0.5), n - 1) as integer) as frame from t""")
def summary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that a summary looks at, of videos fifty times as long."""
    videos = totals(spark, sf_dir).withColumn("total_frames", F.col("total_frames") * 50)
    return features.sampled_frames(videos, SESSION, 25.0)


@query("""
, ranked as (select *, row_number() over (partition by session_id order by frame) as place from tracks where speed >= 40)
select session_id, frame, speed, place from ranked where place <= 30""")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.top_rows(tracks(spark, sf_dir).where("speed >= 40"), SESSION, [F.col("frame").asc()], 30).select(*FRAME, "speed", "place")


@query("select session_id, list_sort(list_distinct(list(team))) as teams from tracks group by all")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).groupBy("session_id").agg(F.sort_array(F.collect_set("team")).alias("teams"))


@query("select page_id, sha256(html) as digest, length(html) as size from pages where html is not null")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").where(html.isNotNull()).select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.char_length(html).cast("long").alias("size"))


@query("""
, spans as (select session_id, type, start_frame, end_frame - start_frame as span, case when end_frame - start_frame < 125 then 1 else 5 end as n from segments)
select session_id, type, cast(floor(start_frame + i * span / n) as bigint) as frame from (select *, unnest(range(n)) as i from spans)""")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced frames of a segment: five, or one where it takes less than five seconds."""
    span = F.col("end_frame") - F.col("start_frame")
    n = F.when(span < 125, 1).otherwise(5)
    made = segments(spark, sf_dir).withColumns({"span": span, "n": n}).withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    return made.select("session_id", "type", F.floor(F.col("start_frame") + F.col("i") * F.col("span") / F.col("n")).alias("frame"))


@query("""
select session_id, frame, round(100.0 * (frame + 1) / total_frames, 4) as progress, round((frame + 1) / 25 * (1 - (frame + 1) / total_frames) / ((frame + 1) / total_frames), 4) as eta_s
from tracks join totals using (session_id)""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = (F.col("frame") + 1) / F.col("total_frames")
    eta = text.time_left((F.col("frame") + 1) / 25, done)
    found = tracks(spark, sf_dir).join(totals(spark, sf_dir), SESSION)
    return found.select(*FRAME, F.round(done * 100, 4).alias("progress"), F.round(eta, 4).alias("eta_s"))


@query("""
, played as (select *, sum(end_frame - start_frame) over (partition by session_id order by start_frame) - (end_frame - start_frame) as out_start from segments where type <> 'halftime')
select t.session_id, t.frame, p.out_start + t.frame - p.start_frame as out_frame from tracks t join played p on p.session_id = t.session_id and t.frame >= p.start_frame and t.frame < p.end_frame""")
def stitched_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a frame lies in the video of the match periods alone."""
    played = segments(spark, sf_dir).where(F.col("type").isin(*MATCH_TYPES))
    return scenes.to_stitched(tracks(spark, sf_dir), played, SESSION).select(*FRAME, "out_frame")


@query("select session_id, frame, mx % 5 as a, my % 4 as b, mx % 3 as c, repeat('0', cast(mx % 5 as bigint)) || repeat('1', cast(my % 4 as bigint)) || repeat('0', cast(mx % 3 as bigint)) as mask from tracks")
def mask_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(F.col("mx") % 5, F.col("my") % 4, F.col("mx") % 3)
    return tracks(spark, sf_dir).select(*FRAME, counts[0].alias("a"), counts[1].alias("b"), counts[2].alias("c"), masks.decode_runs(counts).alias("mask"))


@query("select session_id, least(w, 1280) as w, h from (select session_id, case when session_id % 3 = 0 then 1920 else total_frames end as w0, case when session_id % 3 = 0 then 1080 else 500 end as h0 from totals) q, lateral (select case when h0 > 720 then cast(w0 * 720 / h0 as integer) else w0 end as w, least(h0, 720) as h)")
def overlay_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of an overlay, brought down to a height of 720."""
    third = F.col("session_id") % 3 == 0
    w, h = geometry.overlay_size(F.when(third, 1920).otherwise(F.col("total_frames")), F.when(third, 1080).otherwise(500))
    return totals(spark, sf_dir).select("session_id", F.least(w, F.lit(1280)).alias("w"), h.alias("h"))


@query("""
, strokes as (select session_id, frame // 3 as slot, frame, track_id, team from tracks)
select session_id, string_agg(slot || ':' || track_id, ',' order by slot) as drawings from (
  select session_id, slot, max_by(track_id, frame) as track_id, max_by(team, frame) as team from strokes group by all) where team <> 2 group by session_id""")
def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings by time, the latest of each winning, deleted ones left out, in order."""
    strokes = tracks(spark, sf_dir).withColumn("at", F.floor(F.col("frame") / 3).cast("int"))
    last = jobs.latest(strokes, ["session_id", "at"], [F.desc("frame")]).where("team <> 2")
    listed = last.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", "track_id"))).alias("d"))
    return listed.select("session_id", F.expr("array_join(transform(d, x -> concat(x.at, ':', x.track_id)), ',')").alias("drawings"))


@query("select o_orderkey as id, 'uploads/' || o_orderkey || '/_' || o_orderpriority || '.mp4' as key from orders")
def upload_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("a/_"), F.col("o_orderpriority"), F.lit(".mp4"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("/", F.lit("uploads"), F.col("o_orderkey").cast("string"), text.safe_filename(name)).alias("key"))


@query(f"""
, old as (select id from sessions where created_at < timestamp '{NOW}' - interval 2500 days)
select 'sessions' as kind, count(*) as gone from old union all
select 'tasks', count(*) from tasks where session_id in (select id from old)""")
def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one clean-up removes: expired sessions and the tasks that go with them."""
    gone, orphaned = jobs.cleanup(sessions(spark, sf_dir), tasks(spark, sf_dir), F.lit(NOW).cast("timestamp"), 2500)
    count = F.count(F.lit(1)).alias("gone")
    return gone.agg(count).select(F.lit("sessions").alias("kind"), "gone").union(orphaned.agg(count).select(F.lit("tasks"), "gone"))


@query("""
, sampled as (select p.* from pitch p join (select session_id, max(frame) as last from pitch group by all) using (session_id) where frame % 5 = 0 or frame = last)
select session_id, frame, count(*) filter (track_id <> 10) as n_players, max(case when track_id = 10 then x end) as ball_x, max(case when track_id = 10 then y end) as ball_y,
       max(case when track_id = 10 then x % 3 end) as control from sampled group by all""")
def minimap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimap with ball and control aligned to the sampled frames."""
    own = pitch(spark, sf_dir)
    ball = own.where("track_id = 10").select(*FRAME, "x", "y")
    control = ball.select(*FRAME, (F.col("x") % 3).alias("team"))
    found = exports.minimap_full(own.where("track_id <> 10"), ball, control, SESSION, 25.0)
    return found.select(*FRAME, F.size(F.from_json("players", "array<struct<id: long>>")).cast("long").alias("n_players"), F.col("ball.x").alias("ball_x"), F.col("ball.y").alias("ball_y"), "control")


@query("""
select session_id, frame, max(case when track_id = 3 then round(x / 7.0, 1) end) as target_x, count(*) filter (track_id <> 3) as n_players, round(sum(case when track_id <> 3 then round(y / 7.0, 1) else 0 end), 1) as total_y
from pitch group by all""")
def overlay_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay of every frame: the target, and the other players, to one decimal."""
    own = pitch(spark, sf_dir).withColumns({c: F.col(c) / 7.0 for c in ("x", "y")})
    found = exports.overlay_full(own, SESSION, F.col("track_id") == 3)
    return found.select(*FRAME, F.col("target")[0].alias("target_x"), F.size("players").cast("long").alias("n_players"), F.round(F.aggregate("players", F.lit(0.0), lambda a, p: a + p[2]), 1).alias("total_y"))


@query("""
, drawn as (select t.session_id, t.frame, t.session_id * 31 % greatest(total_frames - 8 + 1, 1) as low from tracks t join totals using (session_id))
select session_id, frame, case when session_id % 2 = 1 then 7 - (frame - low) else frame - low end as "order" from drawn where frame >= low and frame < low + 8""")
def train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight frames to train on, every other one in reverse."""
    draw, back = F.col("session_id") * 31, F.col("session_id") % 2 == 1
    return targets.train_window(tracks(spark, sf_dir).select(*FRAME), SESSION, 8, draw, back)


@query("""
, seen as (select session_id, frame, track_id as obj from pitch where y % 3 <> 0),
w as (select session_id, frame, case when session_id % 2 = 1 then 7 - (frame - 20) else frame - 20 end as "order"
      from (select distinct session_id, frame from pitch) where frame >= 20 and frame < 28),
firsts as (select session_id, arg_min(frame, "order") as frame from w group by all),
chosen as (select session_id, obj from seen join firsts using (session_id, frame)
           qualify row_number() over (partition by session_id order by obj * 7919 % 23, obj) <= 3)
select session_id, frame, "order", obj from seen join w using (session_id, frame) join chosen using (session_id, obj)""")
def train_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three drawn objects of those seen first in a window of eight frames to train on, every other window in reverse."""
    own = pitch(spark, sf_dir)
    frames = own.select(*FRAME).distinct().where("frame >= 20 and frame < 28")
    place = F.col("frame") - 20
    window = frames.withColumn("order", F.when(F.col("session_id") % 2 == 1, 7 - place).otherwise(place))
    seen = own.where("y % 3 <> 0").select(*FRAME, F.col("track_id").alias("obj"))
    return targets.train_objects(window, seen, SESSION, 3, F.col("obj") * 7919 % 23)


@query("select id, user_id from sessions")
def known_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the store does not know are dropped without complaint."""
    odd = sessions(spark, sf_dir).withColumn("unknown", F.lit(1)).select("id", "user_id", "unknown")
    return jobs.only_columns(odd, ["id", "user_id", "status", "progress"])


@query("select session_id, frame, '#' || lpad(to_hex(mx % 256), 2, '0') || '0A' || lpad(to_hex(my % 256), 2, '0') as code, mx % 256 as red, 10 as green, my % 256 as blue from tracks")
def colours_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours to hexadecimal text and back."""
    code = text.colour_to_hex(F.col("my") % 256, F.lit(10), F.col("mx") % 256)
    back = text.hex_to_colour(F.col("code"))
    coded = tracks(spark, sf_dir).select(*FRAME, code.alias("code"))
    return coded.select(*FRAME, F.upper("code").alias("code"), back[2].alias("red"), back[1].alias("green"), back[0].alias("blue"))

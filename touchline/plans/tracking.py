"""Queries of the tracking engine: frame series, joins of frame tables, statistics of play, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import geometry
from touchline.operators import exports, masks, matching, play, scenes, series, stateful, teams
from touchline.plans.inputs import Registry, pitch, segments, table, totals, tracks

registry = Registry()
query = registry.query
SESSION = ["session_id"]


@query("""
select session_id, count(*) as frames, count(*) filter (team = 1) as team1_frames, count(*) filter (team = 2) as team2_frames,
       count(*) filter (team = 0) as neutral_frames, cast(count(*) filter (team = 1) as double) * 100 / count(*) as team1_pct,
       cast(count(*) filter (team = 2) as double) * 100 / count(*) as team2_pct, cast(count(*) filter (team = 0) as double) * 100 / count(*) as neutral_pct
from tracks group by session_id""")
def possession_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.possession_share(tracks(spark, sf_dir), SESSION)


@query("""
, held as (select *, lag(team) over (partition by session_id order by frame) as prior from tracks where team <> 0)
select session_id, count(*) filter (prior <> team) as switches from held group by session_id""")
def possession_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.possession_switches(tracks(spark, sf_dir), SESSION)


@query("""
, counted as (
  select session_id, frame, count(*) filter (team = 1) over w as team1_sum, count(*) filter (team = 2) over w as team2_sum
  from tracks window w as (partition by session_id order by frame rows unbounded preceding))
select *, case when team1_sum + team2_sum > 0 then cast(team1_sum as double) / (team1_sum + team2_sum) else 0 end as team1_share from counted""")
def possession_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = play.cumulative_possession(tracks(spark, sf_dir), SESSION)
    return found.select("session_id", "frame", "team1_sum", "team2_sum", "team1_share")


@query("""
select t.session_id, s.type, s.start_frame, s.end_frame, count(*) as frames, count(*) filter (team = 1) as team1_frames,
       count(*) filter (team = 2) as team2_frames, count(*) filter (team = 0) as neutral_frames,
       cast(count(*) filter (team = 1) as double) * 100 / count(*) as team1_pct, cast(count(*) filter (team = 2) as double) * 100 / count(*) as team2_pct,
       cast(count(*) filter (team = 0) as double) * 100 / count(*) as neutral_pct
from tracks t join segments s on t.session_id = s.session_id and t.frame >= s.start_frame and t.frame < s.end_frame
where s.type <> 'halftime' group by all""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.segment_stats(tracks(spark, sf_dir), segments(spark, sf_dir), SESSION)


@query("""
, clean as (select *, case when speed >= 0.5 and speed <= 34 then speed end as ok from tracks)
select session_id, max(ok) as max_speed, round(avg(ok), 4) as avg_speed, count(ok) as speed_samples, count(*) filter (speed > 90) as rejected_samples,
       cast(max(case when team > 0 then mx / 100 else 0 end) - min(case when team > 0 then mx / 100 else 0 end) as double) as distance_m,
       count(*) filter (team = 1) / 25 as possession_seconds,
       case when count(*) filter (speed > 90) > 0 or count(ok) = 0 then 'suspect' else 'ok' end as reliability
from clean group by session_id""")
def player_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tracks(spark, sf_dir).select(
        "session_id",
        "speed",
        F.when(F.col("speed") > 90, F.col("speed")).alias("speed_rejected"),
        F.when(F.col("team") > 0, F.col("mx") / 100).alias("distance"),
        (F.col("team") == 1).alias("has_ball"),
    )
    return play.player_summary(samples, SESSION, 25.0).withColumn("avg_speed", F.round("avg_speed", 4))


RUNS_SQL = """
, marked as (select *, frame - row_number() over (partition by session_id order by frame) as run from tracks where speed >= 40),
found as (
  select session_id, min(frame) as start, max(frame) as "end", count(*) as length, max(speed) as peak_speed, cast(max(frame) - min(frame) as double) as duration_s
  from marked group by session_id, run having count(*) >= 2)
"""


@query(RUNS_SQL + "select * from found")
def sprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.sprints(tracks(spark, sf_dir), SESSION, fps=1.0, speed=40.0)


@query(
    RUNS_SQL
    + """select t.session_id, count(f.start) as sprint_count, coalesce(avg(duration_s), 0) as avg_duration_s, coalesce(max(duration_s), 0) as max_duration_s, any_value(top) as max_speed_kmh
from (select session_id, max(speed) as top from tracks group by session_id) t left join found f using (session_id) group by t.session_id"""
)
def sprint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.sprint_stats(tracks(spark, sf_dir), sprint_runs(spark, sf_dir), SESSION)


GAPS_SQL = """
, counts as (select session_id, frame, track_id * 7919 % 11 as players from tracks),
smooth as (
  select *, sum(players) over (partition by session_id order by frame rows between 1 preceding and 1 following) / 3 as smoothed from counts),
marked as (select *, frame - row_number() over (partition by session_id order by frame) as run from smooth where smoothed < 5),
gaps as (
  select session_id, cast(min(frame) as integer) as start, cast(max(frame) + 1 as integer) as "end", count(*) as length
  from marked group by session_id, run having count(*) >= 2)
"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tracks(spark, sf_dir).select("session_id", "frame", (F.col("track_id") * 7919 % 11).alias("players"))
    return scenes.play_gaps(counts, SESSION, fps=1.0, gap_s=2.0)


@query(GAPS_SQL + "select * from gaps")
def play_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)


@query(
    GAPS_SQL
    + """, near as (
  select g.*, row_number() over (partition by g.session_id order by length desc, start) as place from gaps g join totals t using (session_id)
  where start between total_frames * 0.25 and total_frames * 0.75 or "end" between total_frames * 0.25 and total_frames * 0.75)
select session_id, start, "end", length from near where place = 1"""
)
def halftime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.halftime(_gaps(spark, sf_dir), totals(spark, sf_dir), SESSION)


FILL_SQL = """
, sparse as (select session_id, frame, case when track_id % 4 = 0 then mx end as v from tracks),
ends as (
  select *, max(case when v is not null then frame end) over a as low, min(case when v is not null then frame end) over b as high,
         last_value(v ignore nulls) over a as va, first_value(v ignore nulls) over b as vb
  from sparse
  window a as (partition by session_id order by frame rows between unbounded preceding and current row),
         b as (partition by session_id order by frame rows between current row and unbounded following))
"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("track_id") % 4 == 0, F.col("mx")).cast("double")
    return tracks(spark, sf_dir).select("session_id", "frame", known.alias("v"))


@query(
    FILL_SQL
    + """select session_id, frame, case when v is not null then v when low is not null and high is not null
  then va + (vb - va) * (frame - low) / (high - low) else coalesce(va, vb) end as v from ends"""
)
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_linear(_sparse(spark, sf_dir), SESSION, ["v"], edges="clamp")


@query(
    FILL_SQL
    + """select session_id, frame, case when v is not null then v when low is not null and high is not null and (frame - low <= 1 or high - frame <= 1)
  then va + (vb - va) * (frame - low) / (high - low) end as v from ends"""
)
def gap_fill_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_linear(_sparse(spark, sf_dir), SESSION, ["v"], limit=1)


@query("select session_id, frame, avg(mx) over (partition by session_id order by frame rows between 2 preceding and 2 following) as smooth from tracks")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rolling(tracks(spark, sf_dir), SESSION, "mx", "smooth", 5).select("session_id", "frame", "smooth")


@query("select session_id, frame, median(mx) over (partition by session_id order by frame rows between 3 preceding and 3 following) as smooth from tracks")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rolling(tracks(spark, sf_dir), SESSION, "mx", "smooth", 7, "median").select("session_id", "frame", "smooth")


@query("""
select session_id, frame, cast(sum(mx) over (partition by session_id order by frame rows between 2 preceding and 1 following) as double) / 4 as smooth from tracks""")
def zero_padded_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.zero_padded_mean(tracks(spark, sf_dir), SESSION, "mx", "smooth", 4).select("session_id", "frame", "smooth")


@query("""
, accepted as (
  select session_id, frame, median(mx) over (partition by session_id order by frame rows between 6 preceding and current row) as middle from tracks where mx <= 6000)
select session_id, frame, a.middle from tracks left join accepted a using (session_id, frame)""")
def last7_accepted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_accepted(tracks(spark, sf_dir), SESSION, "mx", F.col("mx") <= 6000, "middle").select("session_id", "frame", "middle")


@query("""
select a.session_id, a.frame, b.frame as prev_frame, (a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) as squared
from tracks a join tracks b on a.session_id = b.session_id and b.frame = greatest(0, a.frame - 5)""")
def lag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.look_back(tracks(spark, sf_dir), SESSION, ["mx", "my"])
    dx, dy = F.col("mx") - F.col("prev_mx"), F.col("my") - F.col("prev_my")
    return found.select("session_id", "frame", "prev_frame", (dx * dx + dy * dy).alias("squared"))


@query("""
, placed as (select session_id, frame, mx / 4000 as tx, my / 4000 as ty from tracks),
rated as (
  select a.session_id, a.frame, sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2) as step, sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2) * 25 / (a.frame - b.frame) * 3.6 as raw
  from placed a join placed b on a.session_id = b.session_id and b.frame = greatest(0, a.frame - 5) and b.frame < a.frame),
good as (select *, median(raw) over (partition by session_id order by frame rows between 6 preceding and current row) as speed from rated where raw <= 34),
moves as (
  select p.*, g.speed, g.step, r.raw, sqrt((tx - lag(tx) over w) ** 2 + (ty - lag(ty) over w) ** 2) as moved
  from placed p left join good g using (session_id, frame) left join rated r using (session_id, frame) window w as (partition by session_id order by frame))
select session_id, frame, round(speed, 4) as speed, round(sum(step) over w, 4) as distance_ref, round(sum(moved) over w, 4) as distance_true, raw > 34 as rejected
from moves window w as (partition by session_id order by frame rows unbounded preceding)""")
def speed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tracks(spark, sf_dir).select("session_id", "frame", (F.col("mx") / 4000).alias("tx"), (F.col("my") / 4000).alias("ty"))
    found = play.speed_and_distance(placed, SESSION, 25.0)
    rated = F.when(F.col("speed_rejected").isNotNull(), True).when(F.col("speed").isNotNull(), False)
    rounded = [F.round(c, 4).alias(c) for c in ("speed", "distance_ref", "distance_true")]
    return found.select("session_id", "frame", *rounded, rated.alias("rejected"))


@query("""
, steps as (select session_id, frame, abs(mx - lag(mx) over (partition by session_id order by frame)) as step from tracks)
select session_id, frame, cast(sum(step) over (partition by session_id order by frame rows unbounded preceding) as bigint) as travelled from steps""")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.abs(F.col("mx") - F.lag("mx").over(series.ordered(SESSION, "frame")))
    return series.running_total(tracks(spark, sf_dir).withColumn("step", step), SESSION, "step", "travelled").select("session_id", "frame", "travelled")


@query("""
, targets as (select session_id, frame, x, y, 400 as w, 1000 as h from pitch where track_id = 0),
met as (
  select t.session_id, t.frame, p.track_id, sqrt((t.x + t.w / 2 - p.x) ** 2 + (t.y + t.h / 2 - p.y) ** 2) as gap, greatest(150, 0.8 * greatest(t.w, t.h)) as radius
  from targets t join pitch p using (session_id, frame) where p.track_id > 0),
best as (select *, row_number() over (partition by session_id, frame order by gap, track_id) as place from met where gap < radius)
select session_id, frame, b.track_id, round(b.gap, 4) as match_distance from targets left join (select * from best where place = 1) b using (session_id, frame)""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir)
    targets = rows.where("track_id = 0").select("session_id", "frame", "x", "y", F.lit(400).alias("w"), F.lit(1000).alias("h"))
    players = rows.where("track_id > 0").select("session_id", "frame", "track_id", F.col("x").alias("px"), F.col("y").alias("py"))
    found = matching.nearest(targets, players, ["session_id", "frame"])
    return found.select("session_id", "frame", "track_id", F.round("match_distance", 4).alias("match_distance"))


@query("""
, kept as (select session_id, frame, case when track_id % 4 = 0 then frame end as known, case when track_id % 4 = 0 then mx end as v from tracks)
select session_id, frame, last_value(known ignore nulls) over a as before_frame, first_value(known ignore nulls) over b as after_frame,
       last_value(v ignore nulls) over a as v_before, first_value(v ignore nulls) over b as v_after
from kept window a as (partition by session_id order by frame rows between unbounded preceding and current row),
                b as (partition by session_id order by frame rows between 1 following and unbounded following)""")
def asof_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir)
    samples = rows.where("track_id % 4 = 0").select("session_id", "frame", F.col("mx").alias("v"))
    return matching.bracket(rows.select("session_id", "frame"), samples, SESSION, ["v"])


@query("""
, periods as (
  select *, sum(end_frame - start_frame) over (partition by session_id order by start_frame rows unbounded preceding) as out_end
  from segments where type <> 'halftime')
select t.session_id, t.frame as out_frame, p.type, cast(p.start_frame + t.frame - (out_end - (end_frame - start_frame)) as bigint) as frame
from tracks t join periods p on t.session_id = p.session_id and t.frame < out_end and t.frame >= out_end - (end_frame - start_frame)""")
def period_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = tracks(spark, sf_dir).select("session_id", F.col("frame").alias("out_frame"))
    periods = segments(spark, sf_dir).where("type <> 'halftime'")
    return scenes.to_original(frames, periods, SESSION).select("session_id", "out_frame", "type", F.col("frame").cast("long").alias("frame"))


LINE_SQL = """
, ranked as (select *, row_number() over (partition by session_id, frame order by x desc, track_id) as place from pitch where team = 2),
line as (select session_id, frame, avg(x) as line_x, count(*) as deepest from ranked where place <= 4 group by session_id, frame)
"""


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.defensive_line(pitch(spark, sf_dir).where("team = 2"), ["session_id", "frame"])


@query(LINE_SQL + "select * from line")
def defensive_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, sf_dir)


@query(
    LINE_SQL
    + """, beyond as (
  select p.session_id, p.track_id, p.frame, p.frame - row_number() over (partition by p.session_id, p.track_id order by p.frame) as run
  from pitch p join line l using (session_id, frame) where p.team = 1 and p.x > l.line_x - 4000)
select session_id, track_id, min(frame) + 2 as frame, count(*) as length from beyond group by session_id, track_id, run having count(*) >= 3"""
)
def penetrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pitch(spark, sf_dir).where("team = 1").select("session_id", "track_id", "frame", "x")
    line = _line(spark, sf_dir).select("session_id", "frame", (F.col("line_x") - 4000).alias("line_x"))
    return play.penetrations(own, line, ["session_id", "track_id"], line_keys=SESSION)


@query("select session_id, avg(x) filter (team = 1) < avg(x) filter (team = 2) as towards_right from pitch group by session_id")
def attack_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.attack_direction(pitch(spark, sf_dir), SESSION)


@query("""
, direction as (select session_id, avg(x) filter (team = 1) < avg(x) filter (team = 2) as towards_right from pitch group by session_id),
moved as (select session_id, track_id, case when towards_right then x else 12000 - x end as x from pitch join direction using (session_id))
select session_id, track_id, count(*) filter (x < 4000) as defensive, count(*) filter (x between 4000 and 8000) as middle, count(*) filter (x > 8000) as attacking
from moved group by session_id, track_id""")
def pitch_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir)
    return play.pitch_thirds(rows.join(play.attack_direction(rows, SESSION), SESSION), ["session_id", "track_id"], 12000)


@query("""
, counted as (select session_id, team, count(*) as votes, min(frame) as first_seen from tracks group by session_id, team),
ranked as (select *, row_number() over (partition by session_id order by votes desc, first_seen) as place from counted)
select session_id, team, votes from ranked where place = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.majority_vote(tracks(spark, sf_dir), SESSION, "team", "frame")


@query("select session_id, cast(floor(median(team)) as integer) as team from tracks where team > 0 group by session_id")
def tracked_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.median_team(tracks(spark, sf_dir).where("team > 0"), SESSION)


@query("""
, ranked as (select session_id, frame, track_id, cast(row_number() over (partition by session_id, frame order by x * y desc, track_id) as integer) as place from pitch)
select * from ranked where place <= 5""")
def topk_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir).select("session_id", "frame", "track_id", (F.col("x") * F.col("y")).alias("area"))
    return play.top_rows(rows, ["session_id", "frame"], [F.desc("area"), F.asc("track_id")], 5).drop("area")


@query("select session_id, cast(floor(x / 500) as bigint) as cell_x, cast(floor(y / 500) as bigint) as cell_y, count(*) as n from pitch group by all")
def heat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.heat_histogram(pitch(spark, sf_dir), SESSION, 500)


@query("""
select session_id, frame, cast(to_json(list({'x': mx, 'y': my}) over (partition by session_id order by frame rows between 4 preceding and current row)) as varchar) as trail
from tracks""")
def ball_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ball = tracks(spark, sf_dir).select("session_id", "frame", F.col("mx").alias("x"), F.col("my").alias("y"))
    return play.ball_trail(ball, SESSION, ["x", "y"], 5).select("session_id", "frame", F.to_json("trail").alias("trail"))


@query("""
, ends as (select session_id, max(frame) as last_frame from pitch group by session_id)
select session_id, frame, cast(to_json(list({'id': track_id, 'x': x, 'y': y, 't': team} order by track_id)) as varchar) as players
from pitch join ends using (session_id) where frame % 5 = 0 or frame = last_frame group by session_id, frame""")
def minimap_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.minimap(pitch(spark, sf_dir), SESSION, 25.0)


@query("""
select session_id, cast(floor(frame / 12500) as bigint) as chunk, cast(to_json(list([x, y] order by frame)) as varchar) as positions
from pitch where track_id = 3 and frame % 25 = 0 group by all""")
def heatmap_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exports.heatmap(pitch(spark, sf_dir).where("track_id = 3"), SESSION, 25.0)
    return found.select("session_id", "chunk", F.to_json("positions").alias("positions"))


@query("""
select session_id, frame, cast(to_json(list({'track_id': track_id, 'x': x, 'y': y, 'team': team} order by track_id)) as varchar) as rows
from pitch group by session_id, frame""")
def overlay_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exports.per_frame(pitch(spark, sf_dir), SESSION, ["track_id", "x", "y", "team"])
    return found.select("session_id", "frame", F.to_json("rows").alias("rows"))


@query("""
, marks as (select session_id, frame as start_frame, total_frames - 2 as cap from tracks join totals using (session_id) where track_id % 5 = 0)
select *, least(coalesce(lead(start_frame) over (partition by session_id order by start_frame), cap), cap) as end_frame from marks""")
def next_segment_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = tracks(spark, sf_dir).where("track_id % 5 = 0").select("session_id", F.col("frame").alias("start_frame"))
    marks = marks.join(totals(spark, sf_dir), SESSION).select("session_id", "start_frame", (F.col("total_frames") - 2).alias("cap"))
    return scenes.next_segment_end(marks, SESSION, "start_frame", "cap")


@query("""
, periods as (select session_id, start_frame + 1 as start_frame, end_frame - 1 as end_frame from segments where type <> 'halftime')
select session_id, case when start_frame < (select min(start_frame) + 5 from segments) then 'first_half' else 'second_half' end as type, start_frame, end_frame from periods
union all select session_id, 'pre_match', 0, min(start_frame) from periods group by session_id
union all select session_id, 'halftime', min(end_frame), max(start_frame) from periods group by session_id
union all select session_id, 'post_match', max(end_frame), min(total_frames) from periods join totals using (session_id) group by session_id""")
def periods_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = segments(spark, sf_dir).where("type <> 'halftime'")
    periods = periods.select("session_id", (F.col("start_frame") + 1).alias("start_frame"), (F.col("end_frame") - 1).alias("end_frame"))
    return scenes.periods_to_segments(periods, totals(spark, sf_dir), SESSION)


@query("""
select session_id, cast(floor(s / 20) as integer) as chunk, cast(s as integer) as start_frame, cast(least(s + 20, total_frames) as integer) as end_frame
from (select session_id, total_frames, unnest(range(0, total_frames, 20)) as s from totals)""")
def frame_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.chunks(totals(spark, sf_dir), SESSION, 20)


@query("select session_id, frame, mx from tracks where frame >= 10 and frame < 40 and (frame - 10) % 3 = 0")
def strided_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tracks(spark, sf_dir).where("frame >= 10 and frame < 40").withColumn("at", F.col("frame") - 10)
    return exports.sampled(kept, 3, order="at").select("session_id", "frame", "mx")


@query("""
, spine as (select session_id, unnest(range(0, total_frames)) as frame from totals)
select session_id, cast(frame as integer) as frame, count(track_id) as players from spine left join (select * from tracks where track_id % 3 <> 0) using (session_id, frame)
group by all""")
def players_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = series.spine(totals(spark, sf_dir).select("session_id", F.lit(0).alias("low"), (F.col("total_frames") - 1).alias("high")), SESSION, "low", "high")
    some = tracks(spark, sf_dir).where("track_id % 3 <> 0").select("session_id", "frame", "track_id")
    return spine.join(some, ["session_id", "frame"], "left").groupBy("session_id", "frame").agg(F.count("track_id").alias("players"))


@query("""
, spine as (select session_id, unnest(range(0, total_frames)) as frame from totals)
select session_id, cast(frame as integer) as frame from spine anti join (select * from tracks where track_id % 7 <> 0) using (session_id, frame)""")
def missing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = series.spine(totals(spark, sf_dir).select("session_id", F.lit(0).alias("low"), (F.col("total_frames") - 1).alias("high")), SESSION, "low", "high")
    return spine.join(tracks(spark, sf_dir).where("track_id % 7 <> 0").select("session_id", "frame"), ["session_id", "frame"], "left_anti")


@query("""
, marked as (select *, lag(team) over w as one, lag(team, 2) over w as two from tracks window w as (partition by session_id order by frame))
select session_id, frame, coalesce(last_value(case when team <> 0 and team = one and team = two then team end ignore nulls)
  over (partition by session_id order by frame rows between unbounded preceding and current row), 0) as stable from marked""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.debounce(tracks(spark, sf_dir), SESSION, "team", "stable", none=0).select("session_id", "frame", "stable")


@query("""
, sparse as (select session_id, frame, case when track_id % 4 = 0 then mx end as v from tracks)
select session_id, frame, coalesce(last_value(v ignore nulls) over (partition by session_id order by frame rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by session_id order by frame rows between current row and unbounded following)) as v from sparse""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = tracks(spark, sf_dir).select("session_id", "frame", F.when(F.col("track_id") % 4 == 0, F.col("mx")).alias("v"))
    return series.carry_forward(sparse, SESSION, "v", "v")


@query("""
select session_id, frame, track_id, cast((x + x + 40) / 2 as integer) as cx, cast((y + y + 90) / 2 as integer) as cy, x + 20 as foot_x, y + 90 as foot_y,
       round(least(greatest((x + 2 * y + 100) / (1 + y / 1000) * 0.01, 0), 120), 6) as pitch_x, round(least(greatest((2 * x + y) / (1 + y / 1000) * 0.01, 0), 70), 6) as pitch_y
from pitch""")
def pitch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    centre, foot = geometry.box_centre(x, y, x + 40, y + 90), geometry.box_foot(x, x + 40, y + 90)
    h = [F.lit(float(v)) for v in (1, 2, 100, 2, 1, 0, 0)] + [F.lit(1.0) / 1000, F.lit(1.0)]
    at = geometry.to_pitch(x, y, h)
    return pitch(spark, sf_dir).select(
        "session_id", "frame", "track_id", centre["x"].alias("cx"), centre["y"].alias("cy"), foot["x"].alias("foot_x"), foot["y"].alias("foot_y"),
        F.round(at["x"], 6).alias("pitch_x"), F.round(at["y"], 6).alias("pitch_y"),
    )


@query("""
, pairs as (
  select a.session_id, a.frame, a.track_id as a_id, b.track_id as b_id,
         greatest(0, least(a.x, b.x) + 3000 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 2000 - greatest(a.y, b.y)) as inter
  from pitch a join pitch b on a.session_id = b.session_id and a.frame = b.frame and a.team = 1 and b.team = 2)
select session_id, frame, a_id, b_id, round(inter / (2 * 6000000 - inter), 6) as iou from pairs where inter > 0""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir).select("session_id", "frame", "track_id", "team", "x", "y")
    a, b = (rows.where(F.col("team") == t).select("session_id", "frame", F.col("track_id").alias(f"{n}_id"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for t, n in ((1, "a"), (2, "b")))
    box = {n: [F.col(f"{n}x"), F.col(f"{n}y"), F.col(f"{n}x") + 3000, F.col(f"{n}y") + 2000] for n in "ab"}
    found = a.join(b, ["session_id", "frame"]).withColumn("iou", F.round(geometry.iou(box["a"], box["b"]), 6))
    return found.where("iou > 0").select("session_id", "frame", "a_id", "b_id", "iou")


RLE_SQL = """
, pixels as (select session_id, frame as pos, case when team > 0 then 1 else 0 end as on_ from tracks),
flips as (select *, case when on_ <> lag(on_, 1, 0) over (partition by session_id order by pos) then 1 else 0 end as flip from pixels),
numbered as (select *, sum(flip) over (partition by session_id order by pos rows unbounded preceding) as run from flips),
counted as (select session_id, run, count(*) as n from numbered group by session_id, run)
"""


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = tracks(spark, sf_dir).select("session_id", F.col("frame").alias("pos"), (F.col("team") > 0).cast("int").alias("on"))
    return masks.rle_encode(pixels, SESSION)


@query(RLE_SQL + "select session_id, array_to_string(case when min(run) = 0 then [] else [0] end || list(n order by run), ',') as counts from counted group by session_id")
def mask_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).select("session_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("select session_id, count(*) filter (team > 0) as area from tracks group by session_id")
def mask_area_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).select("session_id", masks.rle_area(F.col("counts")).alias("area"))


@query("select session_id, track_id, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2 from pitch group by session_id, track_id")
def mask_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_box(pitch(spark, sf_dir).select("session_id", "track_id", F.col("x").alias("px"), F.col("y").alias("py")), ["session_id", "track_id"])


@query("""
, ranked as (select session_id, frame, track_id, speed, row_number() over (partition by session_id, frame order by speed desc, track_id) as place from pitch)
select session_id, frame, track_id, speed from ranked where place = 1""")
def best_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir).select("session_id", "frame", "track_id", "speed")
    return play.top_rows(rows, ["session_id", "frame"], [F.desc("speed"), F.asc("track_id")], 1).drop("place")


# Folds over the frames of a session, which SQL cannot express; the tests compare them with known cases.


@query()
def possession_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir)
    obj = F.when(F.col("track_id") == 21, "ball").otherwise("player")
    tracked = rows.select(
        "session_id", F.col("frame").cast("int").alias("frame"), obj.alias("obj"), "track_id", "team", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"),
        (F.col("y") - 90).cast("double").alias("y1"), F.col("y").cast("double").alias("y2"), (F.col("x") / 100).alias("tx"), (F.col("y") / 100).alias("ty"),
    )
    return stateful.possession(tracked, SESSION)


@query()
def ball_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.spline_fill(_sparse(spark, sf_dir), SESSION, ["v"])


@query()
def kalman_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("track_id") % 4 == 0
    rows = tracks(spark, sf_dir)
    measures = {"cx": F.col("mx"), "cy": F.col("my"), "aspect": F.lit(0.4), "h": F.lit(100.0)}
    return stateful.kalman_track(rows.select("session_id", "frame", *(F.when(known, v).cast("double").alias(k) for k, v in measures.items())), SESSION)


@query()
def greedy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir).select(
        "session_id", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 3000).alias("x2"), (F.col("y") + 2000).alias("y2"), F.col("speed").alias("conf")
    )
    return stateful.greedy_tracks(rows, SESSION)


@query("""
, boxes as (
  select session_id, frame, track_id as box_id, x as x1, y as y1, x + 3000 as x2, y + 2000 as y2, speed as score,
         row_number() over (partition by session_id, frame order by speed desc, track_id) as place from pitch)
select session_id, frame, k.box_id, k.x1, k.y1, k.x2, k.y2, k.score from (
  with recursive fold as (
    select session_id, frame, 1 as place, [{'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}] as kept from boxes where place = 1
    union all
    select f.session_id, f.frame, f.place + 1,
           case when len(list_filter(f.kept, lambda k: greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))
                  / (12000000.0 - greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))) > 0.3)) > 0 then f.kept
                else list_append(f.kept, {'box_id': b.box_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'score': b.score}) end
    from fold f join boxes b on b.session_id = f.session_id and b.frame = f.frame and b.place = f.place + 1)
  select session_id, frame, unnest(arg_max(kept, place)) as k from fold group by session_id, frame)""")
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitch(spark, sf_dir).select(
        "session_id", "frame", F.col("track_id").alias("box_id"), F.col("x").alias("x1"), F.col("y").alias("y1"),
        (F.col("x") + 3000).alias("x2"), (F.col("y") + 2000).alias("y2"), F.col("speed").alias("score"),
    )
    return masks.suppress(rows, ["session_id", "frame"], 0.3)


@query()
def homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    depth = 1 + y / 100_000
    points = pitch(spark, sf_dir).select("session_id", "frame", x.alias("x"), y.alias("y"), ((x + 50) / depth).alias("u"), ((y - 20) / depth).alias("v"))
    return stateful.homographies(points, SESSION)


@query()
def team_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.assign_teams(table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 3).cast("array<double>").alias("color")), ["label"])


@query(GAPS_SQL + """
, middle as (
  select session_id, start, "end" from (
    select g.*, row_number() over (partition by session_id order by length desc, start) as place from gaps g join totals t using (session_id)
    where start between total_frames * 0.25 and total_frames * 0.75 or "end" between total_frames * 0.25 and total_frames * 0.75) where place = 1)
select session_id, 'first_half' as type, 0 as start_frame, start as end_frame from middle where start > 0
union all select session_id, 'halftime', start, "end" from middle
union all select session_id, 'second_half', "end", total_frames from middle join totals using (session_id) where total_frames > "end"
union all select session_id, 'match', 0, total_frames from totals where session_id not in (select session_id from middle)""")
def detected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final segments of a video: both halves and halftime where one is found, else one match."""
    return scenes.detected_segments(_gaps(spark, sf_dir), totals(spark, sf_dir), SESSION)

"""Feature results of a session, one row each with the result's fixed keys, and series behind its charts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import play
from touchline.operators.series import ordered

WALKING, SPRINT_ZONE = 7.0, 24.0  # of the chart; sprints are found from play.SPRINT_SPEED on
SCALE_FLOOR = 20.0
# Colours of teams that have none of their own.
TEAM_COLOURS = {1: "#3498db", 2: "#e74c3c"}


def possession(control: DataFrame, keys: list[str], fps: float, colours: DataFrame | None = None) -> DataFrame:
    """Percentages and seconds of possession to one decimal, and the teams' colours.

    colours: keys, team, hex; a team without one gets the default.
    """
    shares = play.possession_share(control, keys)
    if colours is None:
        named = shares.withColumns({f"team{t}_color": F.lit(None).cast("string") for t in TEAM_COLOURS})
    else:
        own = colours.groupBy(*keys).agg(*(F.max(F.when(F.col("team") == t, F.col("hex"))).alias(f"team{t}_color") for t in TEAM_COLOURS))
        named = shares.join(own, keys, "left")
    return named.select(
        *keys,
        *(F.round(f"{n}_pct", 1).alias(f"{n}_pct") for n in ("team1", "team2", "neutral")),
        *(F.coalesce(f"team{t}_color", F.lit(c)).alias(f"team{t}_color") for t, c in TEAM_COLOURS.items()),
        *(F.round(F.col(f"{n}_frames") / F.lit(fps), 1).alias(f"{n}_seconds") for n in ("team1", "team2")),
    )


def sprint_analysis(
    samples: DataFrame,
    keys: list[str],
    fps: float,
    speed: float = play.SPRINT_SPEED,
    seconds: float = play.SPRINT_SECONDS,
    located: Column | None = None,
) -> DataFrame:
    """sprint_count, avg_duration_s, max_duration_s, max_speed_kmh of every session of samples; a missing speed counts as 0.

    located: whether a sample's position is known, of which a sprint needs two.
    """
    known = samples.withColumn("speed", F.coalesce(F.nanvl(F.col("speed").cast("double"), F.lit(None).cast("double")), F.lit(0.0)))
    found = play.sprint_stats(known, play.sprints(known, keys, fps, speed, seconds, located), keys)
    digits = {"avg_duration_s": 2, "max_duration_s": 2, "max_speed_kmh": 1}
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})


def defensive_line(own: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """penetration_count, tracked_team, opponent_team: runs of three frames or more beyond the line of opponents (play.facing_line).

    own: keys, frame, team, x of the tracked player; players: keys, frame, team, x of all players.
    """
    team = play.median_team(own, keys).withColumnRenamed("team", "tracked_team")
    faced = play.facing_line(own, players, keys)
    events = play.penetrations(faced.select(*keys, "frame", "x"), faced.select(*keys, "frame", "line_x"), keys)
    counted = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("penetration_count"))
    joined = team.join(counted, keys, "left").withColumn("penetration_count", F.coalesce("penetration_count", F.lit(0)))
    return joined.withColumn("opponent_team", F.when(F.col("tracked_team") == 1, 2).otherwise(1))


def speed_chart(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, speed (0 where there is none), distance (the last known one), zone."""
    upto = ordered(keys, "frame").rowsBetween(Window.unboundedPreceding, 0)
    speed = F.coalesce(F.nanvl("speed", F.lit(None).cast("double")), F.lit(0.0))
    found = samples.withColumns({"speed": speed, "distance": F.coalesce(F.last("distance", True).over(upto), F.lit(0.0))})
    return found.select(*keys, "frame", "speed", "distance", zone(F.col("speed")).alias("zone"))


def zone(speed: Column) -> Column:
    return F.when(speed >= SPRINT_ZONE, "sprint").when(speed >= WALKING, "run").otherwise("walk")


def heat(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a histogram smoothed by a 3 by 3 kernel (1 2 1, 2 4 2, 1 2 1) / 16."""
    near = [(dx, dy, (2 - abs(dx)) * (2 - abs(dy))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    shifts = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in near))
    spread = histogram.select("*", F.inline(shifts))
    cell = [(F.col("cell_x") + F.col("dx")).alias("cell_x"), (F.col("cell_y") + F.col("dy")).alias("cell_y")]
    return spread.select(*keys, *cell, (F.col("n") * F.col("w") / 16.0).alias("part")).groupBy(*keys, "cell_x", "cell_y").agg(F.sum("part").alias("density"))


def gaussian(width: int, sigma: float | None = None) -> list[float]:
    """Weights of a one-dimensional kernel of an odd width; without sigma, the one that image libraries take for the width."""
    sigma = sigma or 0.3 * ((width - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - width // 2) ** 2) / (2 * sigma * sigma)) for i in range(width)]
    return [w / sum(raw) for w in raw]


def smooth_heat(histogram: DataFrame, keys: list[str], width: int = 101, sigma: float | None = None) -> DataFrame:
    """Cells of a histogram (cell_x, cell_y, n) smoothed by a Gaussian: one pass along x, whose sums are added up, then one along y.

    A cell spreads to 2 * width others instead of width squared; no grid is made, so the pitch may be of any size.
    """
    weights = F.array(*(F.struct(F.lit(i - width // 2).alias("__by"), F.lit(w).alias("__w")) for i, w in enumerate(gaussian(width, sigma))))
    found = histogram.select(*keys, "cell_x", "cell_y", F.col("n").cast("double").alias("density"))
    for axis in ("cell_x", "cell_y"):
        other = "cell_y" if axis == "cell_x" else "cell_x"
        spread = found.select(*keys, axis, other, "density", F.inline(weights))
        moved = spread.select(*keys, (F.col(axis) + F.col("__by")).alias(axis), other, (F.col("density") * F.col("__w")).alias("part"))
        found = moved.groupBy(*keys, "cell_x", "cell_y").agg(F.sum("part").alias("density"))
    return found


def radial_heat(positions: DataFrame, keys: list[str], cell: float, radius: int, alpha: float = 0.18) -> DataFrame:
    """Opacity of the cells around positions (x, y): dots that fade from alpha to nothing over ``radius`` cells, laid over each other: 1 - prod(1 - a)."""
    near = [(i, j, alpha * (1 - math.hypot(i, j) / radius)) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if math.hypot(i, j) < radius]
    dots = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(math.log1p(-a)).alias("clear")) for i, j, a in near))
    counted = play.heat_histogram(positions, keys, cell)
    spread = counted.select(*keys, "cell_x", "cell_y", "n", F.inline(dots))
    at = [(F.col("cell_x") + F.col("dx")).alias("cell_x"), (F.col("cell_y") + F.col("dy")).alias("cell_y")]
    found = spread.select(*keys, *at, (F.col("n") * F.col("clear")).alias("clear")).groupBy(*keys, "cell_x", "cell_y")
    return found.agg((1 - F.exp(F.sum("clear"))).alias("opacity"))


def thirds_share(counts: DataFrame) -> DataFrame:
    """Counts of the thirds as percentages of their sum; 0 without any."""
    total = F.col("defensive") + F.col("middle") + F.col("attacking")
    return counts.withColumns({f"{c}_pct": F.when(total > 0, F.col(c) * 100.0 / total).otherwise(0.0) for c in ("defensive", "middle", "attacking")})


def speed_scale(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The largest speed of all segments, 20 at least."""
    return stats.groupBy(*keys).agg(F.greatest(F.lit(SCALE_FLOOR), F.max("max_speed")).alias("scale"))


def match_time(segments: DataFrame, keys: list[str], fps: float, played: tuple[str, ...]) -> DataFrame:
    """Seconds of match segments and of the others."""
    length, is_match = F.col("end_frame") - F.col("start_frame"), F.col("type").isin(*played)
    return segments.groupBy(*keys).agg(
        (F.sum(F.when(is_match, length).otherwise(0)) / F.lit(fps)).alias("match_s"),
        (F.sum(F.when(is_match, 0).otherwise(length)) / F.lit(fps)).alias("skipped_s"),
    )


def pie(shares: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice, share of possession shares in percent, without slices of 0; a missing neutral share is what the teams leave."""
    rest = F.coalesce("neutral_pct", F.greatest(F.lit(0.0), 100.0 - F.col("team1_pct") - F.col("team2_pct")))
    slices = F.map_from_arrays(F.array(*map(F.lit, ("team1", "team2", "neutral"))), F.array("team1_pct", "team2_pct", rest))
    return shares.select(*keys, F.explode(slices).alias("slice", "share")).where("share > 0")


def summary_payload(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object a session of all its other columns."""
    return stats.select(*keys, F.to_json(F.struct(*(c for c in stats.columns if c not in keys))).alias("payload"))


def period_series(samples: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Distance covered, mean and largest clean speed of each period (type, start_frame, end_frame); 0 and nulls without samples.

    samples: keys, frame, speed, distance (metres so far).
    """
    from touchline.operators.matching import in_ranges

    met = in_ranges(samples, periods, keys)
    speed = play.clean_speed(F.col("speed").cast("double"))
    found = met.groupBy(*keys, "start_frame").agg(
        (F.max("distance") - F.min("distance")).alias("__metres"), F.avg(speed).alias("avg_speed_kmh"), F.max(speed).alias("max_speed_kmh")
    )
    named = periods.select(*keys, "start_frame", F.replace(F.col("type"), F.lit("_"), F.lit(" ")).alias("name"))
    joined = named.join(found, [*keys, "start_frame"], "left")
    return joined.select(*keys, "start_frame", "name", F.coalesce("__metres", F.lit(0.0)).alias("distance_m"), "avg_speed_kmh", "max_speed_kmh")


def sampled_frames(videos: DataFrame, keys: list[str], fps: float, most: int = 60) -> DataFrame:
    """nth, frame of the frames looked at in each video (total_frames): frame_rate() a second, ``most`` at most.

    The k-th is the video's frame nearest the k-th tick of that rate, the last frame at most.
    """
    rate = frame_rate(F.greatest(F.col("total_frames") / F.lit(fps), F.lit(1.0)), most)
    asked = videos.select(*keys, "total_frames", rate.alias("__rate"))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.round(F.col("total_frames") / F.lit(fps) * F.col("__rate")).cast("int")))
    ticks = asked.select(*keys, "total_frames", "__rate", F.explode(F.sequence(F.lit(0), n - 1)).alias("nth"))
    frame = F.least(F.floor(F.col("nth") / F.col("__rate") * F.lit(fps) + 0.5).cast("int"), F.col("total_frames").cast("int") - 1)
    return ticks.select(*keys, "nth", frame.alias("frame"))


def frame_rate(duration: Column, most: int = 60) -> Column:
    """Frames a second to look at: one, but most frames in all."""
    return F.least(F.lit(1.0), F.lit(float(most)) / duration)


def evaluate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """J, F and their mean, times 100, of each object (keys) from its frames' region overlap and boundary score.

    Counts of pixels: inter and union of regions, and hits, found and wanted of boundaries. Both empty: 1.
    """
    j = F.when(F.col("union_px") > 0, F.col("inter_px") / F.col("union_px")).otherwise(1.0)
    both = F.col("found_px") + F.col("wanted_px")
    f = F.when(both > 0, 2.0 * F.col("hit_px") / both).otherwise(1.0)
    found = scores.groupBy(*keys).agg((F.avg(j) * 100).alias("j"), (F.avg(f) * 100).alias("f"))
    return found.withColumn("jf", (F.col("j") + F.col("f")) / 2)


def per_video(evaluated: DataFrame, video: str, obj: str, value: str) -> DataFrame:
    """A map from object to value for each video."""
    return evaluated.groupBy(video).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(obj, value)))).alias("objects"))


#: Features by name; each takes its inputs and gives one row a session.
FEATURES: dict[str, Callable[..., DataFrame]] = {
    "possession": possession,
    "sprint_analysis": sprint_analysis,
    "defensive_line": defensive_line,
    "speed_chart": speed_chart,
    "heatmap": heat,
    "ai_summary": summary_payload,
}

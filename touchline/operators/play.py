"""Statistics of play: possession, players, sprints, pitch zones, defensive lines, teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.matching import look_back
from touchline.operators.series import last_accepted, ordered, running_total, runs
from touchline.schemas import MATCH_TYPES

SPEED_LOW, SPEED_HIGH = 0.5, 34.0
SPRINT_SPEED, SPRINT_SECONDS = 25.0, 2.0


def clean_speed(speed: Column) -> Column:
    """Speeds of 0.5 to 34 km/h; others, NaN too, are null."""
    return F.when(~F.isnan(speed) & speed.between(SPEED_LOW, SPEED_HIGH), speed)


def possession_share(control: DataFrame, keys: list[str]) -> DataFrame:
    """Frames and percentages of team 1, team 2 and neither; percentages of an empty group are 0."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    count = {name: F.sum(F.when(F.col("team") == team, 1).otherwise(0)) for name, team in (("team1", 1), ("team2", 2), ("neutral", 0))}
    return control.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *(c.alias(f"{name}_frames") for name, c in count.items()),
        *((c * 100.0 / n).alias(f"{name}_pct") for name, c in count.items()),
    )


def possession_switches(control: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """How often the team in control differs from the one before it; neutral frames do not count."""
    held = control.where(F.col("team") != 0).withColumn("before", F.lag("team").over(ordered(keys, order)))
    return held.groupBy(*keys).agg(F.sum(F.when(F.col("before") != F.col("team"), 1).otherwise(0)).alias("switches"))


def cumulative_possession(control: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """Frames of each team up to every frame, and team 1's share of both."""
    upto = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    one, two = (F.sum(F.when(F.col("team") == t, 1).otherwise(0)).over(upto) for t in (1, 2))
    counted = control.withColumns({"team1_sum": one, "team2_sum": two})
    both = F.col("team1_sum") + F.col("team2_sum")
    return counted.withColumn("team1_share", F.when(both > 0, F.col("team1_sum") / both).otherwise(0.0))


def segment_stats(control: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Possession by match segment; halftime and the time before and after the match are left out."""
    played = segments.where(F.col("type").isin(*MATCH_TYPES))
    met = control.join(played, keys).where("frame >= start_frame and frame < end_frame")
    return possession_share(met, [*keys, "type", "start_frame", "end_frame"])


def player_summary(samples: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Speed, distance and possession of a player over matched samples (speed, speed_rejected, distance, has_ball)."""
    speed, travelled = clean_speed(F.col("speed")), F.coalesce("distance", F.lit(0.0))
    found = samples.groupBy(*keys).agg(
        F.max(speed).alias("max_speed"),
        F.avg(speed).alias("avg_speed"),
        F.count(speed).alias("speed_samples"),
        F.count("speed_rejected").alias("rejected_samples"),
        (F.max(travelled) - F.min(travelled)).alias("distance_m"),
        (F.sum(F.coalesce("has_ball", F.lit(False)).cast("int")) / F.lit(fps)).alias("possession_seconds"),
    )
    doubtful = (F.col("rejected_samples") > 0) | (F.col("speed_samples") == 0)
    return found.withColumn("reliability", F.when(doubtful, "suspect").otherwise("ok"))


def sprints(
    samples: DataFrame, keys: list[str], fps: float, speed: float = SPRINT_SPEED, seconds: float = SPRINT_SECONDS, located: Column | None = None
) -> DataFrame:
    """Runs of frames at sprint speed of the minimum length: start, end, length, duration (end left out), peak.

    located: whether a frame's position is known; a sprint then needs two such frames, to be drawn.
    """
    more = (F.max("speed").alias("peak_speed"), F.count_if(F.lit(True) if located is None else located).alias("__located"))
    peaks = runs(samples, keys, F.col("speed") >= speed, least=max(1, int(seconds * fps)), more=more)
    kept = peaks if located is None else peaks.where("__located >= 2")
    return kept.drop("__located").withColumn("duration_s", (F.col("end") - F.col("start")) / F.lit(fps))


def sprint_stats(samples: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Number and duration of the sprints found, and the top speed of all samples; sessions without sprints have zeros."""
    counted = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sprint_count"), F.avg("duration_s").alias("avg_duration_s"), F.max("duration_s").alias("max_duration_s")
    )
    tops = samples.groupBy(*keys).agg(F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed_kmh"))
    none = {"sprint_count": F.lit(0).cast("long"), "avg_duration_s": F.lit(0.0), "max_duration_s": F.lit(0.0)}
    found = tops.join(counted, keys, "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return found.select(*keys, *none, "max_speed_kmh")


def speed_and_distance(tracks: DataFrame, keys: list[str], fps: float, back: int = 5, top: float = SPEED_HIGH) -> DataFrame:
    """Speed over a look-back of some frames, smoothed by the last seven accepted ones, and distance.

    tracks: keys, frame, tx, ty (metres). distance_ref adds up every accepted look-back
    displacement, which overlap; distance_true adds up the steps between rows.
    """
    past = look_back(tracks.select(*keys, "frame", "tx", "ty"), keys, ["tx", "ty"], back).where("prev_frame < frame")
    metres = F.sqrt(F.pow(F.col("tx") - F.col("prev_tx"), 2) + F.pow(F.col("ty") - F.col("prev_ty"), 2))
    raw = past.withColumn("step", metres).withColumn("raw", F.col("step") * fps / (F.col("frame") - F.col("prev_frame")) * 3.6)
    smoothed = last_accepted(raw, keys, "raw", F.col("raw") <= top, "speed")
    good = F.col("raw") <= top
    rated = smoothed.select(
        *keys, "frame", "speed", F.when(~good, F.round("raw", 1)).alias("speed_rejected"), F.when(good, F.col("step")).alias("step")
    )
    joined = tracks.join(rated, [*keys, "frame"], "left")
    joined = running_total(joined, keys, "step", "distance_ref")
    where = ordered(keys, "frame")
    moved = F.sqrt(F.pow(F.col("tx") - F.lag("tx").over(where), 2) + F.pow(F.col("ty") - F.lag("ty").over(where), 2))
    return running_total(joined.withColumn("moved", moved), keys, "moved", "distance_true").drop("step", "moved")


def majority_vote(votes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value; of equal ones that seen first."""
    counted = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first_seen"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("less"), "first_seen", value)).alias("best"))
    return best.select(*keys, F.col(f"best.{value}").alias(value), (-F.col("best.less")).alias("votes"))


def median_team(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Median of a tracked player's team numbers, rounded down; samples without a team do not count, and without any it is 1."""
    known = F.when(F.col("team") != 0, F.col("team"))
    return samples.groupBy(*keys).agg(F.coalesce(F.floor(F.percentile(known, 0.5)).cast("int"), F.lit(1)).alias("team"))


def facing_line(own: DataFrame, players: DataFrame, keys: list[str], order: str = "frame", deepest: int = 4) -> DataFrame:
    """line_x of the opponents that a tracked player faces in each frame: keys, frame, x, line_x, where both are known.

    own: keys, frame, x of the player; players: keys, frame, team, x of all, of which those of the other
    team than the player's median team count. The line is the mean of the opponents with the smallest x,
    where the player stands before the mean of all opponents, and of those with the largest x otherwise.
    """
    opponent = F.when(F.col("__team") == 1, 2).otherwise(1)
    side = median_team(own, keys).withColumnRenamed("team", "__team")
    met = players.join(side, keys).where((F.col("team") == opponent) & F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")))
    lines = met.groupBy(*keys, order).agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("__xs"))  # players of a frame
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    low, high = F.slice("__xs", 1, deepest), F.expr(f"slice(__xs, -least(size(__xs), {deepest}), {deepest})")
    line = F.when(F.col("x") < mean(F.col("__xs")), mean(low)).otherwise(mean(high))
    placed = own.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")))
    return placed.join(lines, [*keys, order]).select(*keys, order, "x", line.alias("line_x"))


def attack_direction(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Whether team 1 attacks towards larger x: its mean x is less than that of team 2."""
    mean = [F.avg(F.when(F.col("team") == t, F.col("x"))) for t in (1, 2)]
    return positions.groupBy(*keys).agg((mean[0] < mean[1]).alias("towards_right"))


def pitch_thirds(positions: DataFrame, keys: list[str], length: float) -> DataFrame:
    """Counts of a player's positions (x, towards_right) in the defensive, middle and attacking third."""
    low, high = length / 3, 2 * length / 3
    x = F.when(F.col("towards_right"), F.col("x")).otherwise(F.lit(length) - F.col("x"))
    return positions.groupBy(*keys).agg(
        F.sum(F.when(x < low, 1).otherwise(0)).alias("defensive"),
        F.sum(F.when((x >= low) & (x <= high), 1).otherwise(0)).alias("middle"),
        F.sum(F.when(x > high, 1).otherwise(0)).alias("attacking"),
    )


def defensive_line(players: DataFrame, keys: list[str], deepest: int = 4, highest: bool = True) -> DataFrame:
    """Mean x of the deepest opponents of each frame (the largest x if highest), and how many there were."""
    order = [F.desc("x") if highest else F.asc("x"), F.asc("track_id")]
    ranked = players.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= deepest).groupBy(*keys).agg(F.avg("x").alias("line_x"), F.count(F.lit(1)).alias("deepest"))


def penetrations(own: DataFrame, line: DataFrame, keys: list[str], order: str = "frame", least: int = 3, line_keys: list[str] | None = None) -> DataFrame:
    """Each run of at least three frames in which x is beyond the line, at its third frame. line_keys: keys that the line has (default: all)."""
    joined = own.join(line, [*(line_keys or keys), order], "left")
    found = runs(joined, keys, F.col("x") > F.col("line_x"), order, least)
    return found.select(*keys, (F.col("start") + least - 1).alias(order), "length")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, such as the 40 largest boxes of a frame."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("place") <= most)


def heat_histogram(positions: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Positions in square cells of the pitch."""
    return positions.groupBy(*keys, F.floor(F.col("x") / cell).alias("cell_x"), F.floor(F.col("y") / cell).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def ball_trail(ball: DataFrame, keys: list[str], columns: list[str], most: int = 30, order: str = "frame") -> DataFrame:
    """The last positions up to each frame, oldest first."""
    return ball.withColumn("trail", F.collect_list(F.struct(*columns)).over(ordered(keys, order).rowsBetween(-(most - 1), 0)))

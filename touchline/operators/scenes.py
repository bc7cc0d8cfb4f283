"""Segments of a match: found from the players in view, or made from given periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.series import ordered, runs, zero_padded_mean


def play_gaps(counts: DataFrame, keys: list[str], fps: float, players: int = 5, smooth_s: float = 3.0, gap_s: float = 30.0) -> DataFrame:
    """Runs of frames whose smoothed number of players is too small, of the least length: start, end (excluded), length."""
    smoothed = zero_padded_mean(counts, keys, "players", "smoothed", max(1, int(smooth_s * fps)))
    found = runs(smoothed, keys, F.col("smoothed") < players, least=max(1, int(gap_s * fps)))
    return found.withColumn("end", F.col("end") + 1)


def halftime(gaps: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The longest gap with an end in the middle half of the frames (total_frames); of equal ones the first."""
    low, high = F.col("total_frames") * 0.25, F.col("total_frames") * 0.75
    met = gaps.join(totals, keys).where(F.col("start").between(low, high) | F.col("end").between(low, high))
    best = met.groupBy(*keys).agg(F.min(F.struct((-F.col("length")).alias("less"), "start", "end")).alias("best"))
    return best.select(*keys, F.col("best.start").alias("start"), F.col("best.end").alias("end"), (-F.col("best.less")).alias("length"))


def periods_to_segments(periods: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that cover a video from its periods: type, start_frame, end_frame.

    The first of several periods is first_half, the second second_half, a single one and
    any later one match; what lies before is pre_match, between halftime, after post_match.
    """
    where = ordered(keys, "start_frame")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.row_number().over(where)
    own = periods.withColumns({"place": place, "n": n, "before": F.coalesce(F.lag("end_frame").over(where), F.lit(0))})
    name = F.when(F.col("n") == 1, "match").when(F.col("place") == 1, "first_half").when(F.col("place") == 2, "second_half").otherwise("match")
    played = own.select(*keys, name.alias("type"), "start_frame", "end_frame")
    gap = own.select(
        *keys, F.when(F.col("place") == 1, "pre_match").otherwise("halftime").alias("type"), F.col("before").alias("start_frame"), F.col("start_frame").alias("end_frame")
    )
    tail = periods.groupBy(*keys).agg(F.max("end_frame").alias("start_frame")).join(totals, keys)
    tail = tail.select(*keys, F.lit("post_match").alias("type"), "start_frame", F.col("total_frames").alias("end_frame"))
    return played.union(gap).union(tail).where(F.col("end_frame") > F.col("start_frame"))


def period_offsets(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Where each period starts in the video of all periods put together: out_start, out_end."""
    length = F.col("end_frame") - F.col("start_frame")
    upto = ordered(keys, "start_frame").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("out_end", F.sum(length).over(upto)).withColumn("out_start", F.col("out_end") - length)


def to_original(frames: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of the joined video (out_frame) with the frame they come from."""
    met = frames.join(period_offsets(periods, keys), keys).where("out_frame >= out_start and out_frame < out_end")
    return met.withColumn("frame", F.col("start_frame") + F.col("out_frame") - F.col("out_start"))


def next_segment_end(marks: DataFrame, keys: list[str], start: str, cap: str) -> DataFrame:
    """Each mark with its end: the next mark's start in its group, but the cap at most, and the cap for the last."""
    return marks.withColumn("end_frame", F.least(F.coalesce(F.lead(start).over(ordered(keys, start)), F.col(cap)), F.col(cap)))


def chunks(totals: DataFrame, keys: list[str], size: int = 500) -> DataFrame:
    """chunk, start_frame, end_frame of every so many frames of a video."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("total_frames") - 1, F.lit(0)), F.lit(size))).alias("start_frame")
    made = totals.select(*keys, "total_frames", starts)
    return made.select(*keys, (F.col("start_frame") / size).cast("int").alias("chunk"), "start_frame", F.least(F.col("start_frame") + size, "total_frames").alias("end_frame"))


def to_stitched(frames: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of the whole video with their place (out_frame) in the video of all periods; others are left out."""
    met = frames.join(period_offsets(periods, keys), keys).where("frame >= start_frame and frame < end_frame")
    return met.withColumn("out_frame", F.col("out_start") + F.col("frame") - F.col("start_frame"))


def long_enough(least: Column) -> Column:
    """Whether a period has the least number of frames."""
    return F.col("end_frame") - F.col("start_frame") >= least


def detected_segments(gaps: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """type, start_frame, end_frame: halves and halftime of videos that have one, a single match of the others."""
    found = totals.join(halftime(gaps, totals, keys), keys, "left")
    parts = [("first_half", F.lit(0), F.col("start")), ("halftime", F.col("start"), F.col("end")), ("second_half", F.col("end"), F.col("total_frames"))]
    halves = F.array(*(F.struct(F.lit(t).alias("type"), a.cast("int").alias("start_frame"), b.cast("int").alias("end_frame")) for t, a, b in parts))
    whole = F.array(F.struct(F.lit("match").alias("type"), F.lit(0).alias("start_frame"), F.col("total_frames").cast("int").alias("end_frame")))
    return found.select(*keys, F.inline(F.when(F.col("start").isNull(), whole).otherwise(halves))).where("end_frame > start_frame")

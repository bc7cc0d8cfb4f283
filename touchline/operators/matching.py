"""Joins of frame tables: range, as-of, lag and nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import distance

MATCH_RADIUS = 150.0


def in_ranges(frames: DataFrame, ranges: DataFrame, keys: list[str], order: str = "frame", start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """frames with the columns of the range that holds them, start <= frame < end; others drop out.

    Ranges of one key must not overlap for a frame to come once, and should be few, as they join on the key
    alone; first_range() is for many, or overlapping ones.
    """
    return frames.join(ranges, keys).where((F.col(order) >= F.col(start)) & (F.col(order) < F.col(end)))


def first_range(frames: DataFrame, ranges: DataFrame, keys: list[str], order: str = "frame", start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """frames with the columns of the first range (by start, then end) that holds them, start <= frame < end; others drop out.

    A join on bins: a range of length L lies in at most two bins of the power of two from L on, and
    a frame in one bin of each such width that occurs (64 at most), so neither many ranges of a key nor long
    ones multiply by its frames. Equal rows of frames all come; empty ranges hold nothing, nor do ranges with nulls.
    """
    length = F.col(end) - F.col(start)
    sized = ranges.where(length > 0).withColumn("__width", F.expr(f"shiftleft(1L, length(trim(leading '0' from bin(`{end}` - `{start}` - 1))))"))
    widths = [r["__width"] for r in sized.select("__width").distinct().collect()]  # powers of two, 64 at most
    low, high = F.floor(F.col(start) / F.col("__width")), F.floor((F.col(end) - 1) / F.col("__width"))
    binned = sized.withColumn("__bin", F.explode(F.sequence(low, high)))
    rest = [c for c in ranges.columns if c not in keys]
    binned = binned.select(*keys, "__width", "__bin", F.struct(start, end, *(c for c in rest if c not in (start, end))).alias("__range"))
    spots = frames.select(*keys, order).distinct()
    spots = spots.withColumn("__width", F.explode(F.array(*map(F.lit, widths)) if widths else F.array().cast("array<bigint>")))
    spots = spots.withColumn("__bin", F.floor(F.col(order) / F.col("__width")))
    met = spots.join(binned, [*keys, "__width", "__bin"]).where((F.col(order) >= F.col(f"__range.{start}")) & (F.col(order) < F.col(f"__range.{end}")))
    best = met.groupBy(*keys, order).agg(F.min("__range").alias("__range"))
    return frames.join(best, [*keys, order]).select(*frames.columns, *(F.col(f"__range.{c}").alias(c) for c in rest))


def bracket(frames: DataFrame, samples: DataFrame, keys: list[str], columns: list[str], order: str = "frame") -> DataFrame:
    """frames with the latest sample at or before each and the next one after it.

    Samples are spread over the frames by windows, not joined to each: columns get the
    suffixes _before and _after, with before_frame and after_frame.
    """
    marked = samples.select(*keys, order, *columns, F.lit(1).alias("__sample"))
    asked = frames.select(*keys, order, *(F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in columns), F.lit(0).alias("__sample"))
    both = marked.unionByName(asked)
    where = Window.partitionBy(*keys).orderBy(F.col(order), F.desc("__sample"))
    past = where.rowsBetween(Window.unboundedPreceding, 0)
    future = where.rowsBetween(1, Window.unboundedFollowing)
    row = F.when(F.col("__sample") == 1, F.struct(order, *columns))
    found = both.withColumns({"__past": F.last(row, True).over(past), "__next": F.first(row, True).over(future)}).where("__sample = 0")
    return found.select(
        *keys,
        order,
        F.col(f"__past.{order}").alias("before_frame"),
        F.col(f"__next.{order}").alias("after_frame"),
        *(F.col(f"__past.{c}").alias(f"{c}_before") for c in columns),
        *(F.col(f"__next.{c}").alias(f"{c}_after") for c in columns),
    )


def look_back(tracks: DataFrame, keys: list[str], columns: list[str], back: int = 5, order: str = "frame") -> DataFrame:
    """tracks with the columns of the same track ``back`` frames before (frame 0 at least), by frame number, where it is known."""
    past = tracks.select(*keys, F.col(order).alias("prev_frame"), *(F.col(c).alias(f"prev_{c}") for c in columns))
    asked = tracks.withColumn("prev_frame", F.greatest(F.lit(0), F.col(order) - back))
    return asked.join(past, [*keys, "prev_frame"])


def nearest(targets: DataFrame, players: DataFrame, keys: list[str], radius: float = MATCH_RADIUS, share: float = 0.8) -> DataFrame:
    """Every target with the nearest player of its frame, if closer than max(radius, share of the box); else nulls.

    targets: keys, x, y, w, h; players: keys, track_id, px, py. Ties go to the smallest
    track_id. A frame's players meet its target only.
    """
    centre = targets.withColumns({"__cx": F.col("x") + F.col("w") / 2, "__cy": F.col("y") + F.col("h") / 2})
    gap = distance(F.col("__cx"), F.col("__cy"), F.col("px"), F.col("py"))
    limit = F.greatest(F.lit(radius), F.lit(share) * F.greatest("w", "h"))
    met = centre.join(players, keys).withColumn("match_distance", gap).where(F.col("match_distance") < limit)
    best = met.groupBy(*keys).agg(F.min(F.struct("match_distance", "track_id")).alias("best"))
    return targets.join(best, keys, "left").select(*targets.columns, "best.track_id", "best.match_distance")

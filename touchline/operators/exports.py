"""Compact JSON-ready exports of tracks: minimap, heatmap and overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.folders import written


def sampled(df: DataFrame, stride: int, last: Column | None = None, order: str = "frame") -> DataFrame:
    """Every stride-th frame, and the last one."""
    keep = F.col(order) % stride == 0
    return df.where(keep | (F.col(order) == last) if last is not None else keep)


def stride_of(fps: float, hertz: float) -> int:
    return max(1, round(fps / hertz))


def per_frame(df: DataFrame, keys: list[str], columns: list[str], order: str = "frame", out: str = "rows") -> DataFrame:
    """One row for each frame with its rows as a sorted array of structs; a frame has few rows."""
    return df.groupBy(*keys, order).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(out))


def minimap(tracks: DataFrame, keys: list[str], fps: float, hertz: float = 5.0, order: str = "frame") -> DataFrame:
    """players (sorted JSON array of id, x, y, team) of frames sampled at 5 Hz, and of the last frame."""
    last = tracks.groupBy(*keys).agg(F.max(order).alias("__last"))
    kept = sampled(tracks.join(last, keys), stride_of(fps, hertz), F.col("__last"), order)
    rows = per_frame(kept.select(*keys, order, F.col("track_id").alias("id"), "x", "y", F.col("team").alias("t")), keys, ["id", "x", "y", "t"], order)
    return rows.select(*keys, order, F.to_json("rows").alias("players"))


def heatmap(matched: DataFrame, keys: list[str], fps: float, order: str = "frame") -> DataFrame:
    """positions of the target, one a second, in frame order, in chunks of 500 seconds."""
    kept = sampled(matched, stride_of(fps, 1.0), order=order).withColumn("chunk", F.floor(F.col(order) / F.lit(500 * fps)))
    rows = kept.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct(order, "x", "y"))).alias("rows"))
    return rows.select(*keys, "chunk", F.transform("rows", lambda r: F.array(r["x"], r["y"])).alias("positions"))


def minimap_full(players: DataFrame, ball: DataFrame, control: DataFrame, keys: list[str], fps: float, order: str = "frame") -> DataFrame:
    """minimap() with the ball (x, y) and the team in control of the same frames; null where there is none."""
    rows = minimap(players, keys, fps, order=order)
    held = ball.select(*keys, order, F.struct("x", "y").alias("ball")).join(control.select(*keys, order, F.col("team").alias("control")), [*keys, order], "full")
    return rows.join(held, [*keys, order], "left")


def overlay_full(rows: DataFrame, keys: list[str], is_target: Column, order: str = "frame") -> DataFrame:
    """target [x, y] and players [id, x, y] of every frame, to one decimal."""
    x, y = F.round("x", 1), F.round("y", 1)
    return rows.groupBy(*keys, order).agg(
        F.first(F.when(is_target, F.array(x, y)), True).alias("target"),
        F.sort_array(F.collect_list(F.when(~is_target, F.array(F.col("track_id").cast("double"), x, y)))).alias("players"),
    )


def equal_parts(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows with ``part`` from 1 to parts, of consecutive rows by order, the first ones a row larger where they can't be equal.

    Rows are sorted by ranges; a row's place is its place within its range after the rows of the ranges before it.
    """
    ranged = rows.repartitionByRange(F.col(order), F.monotonically_increasing_id()).sortWithinPartitions(order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "parts")  # partition number in the upper bits, row in the lower 33
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    starts = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    nth = placed.withColumns({"__range": part, "__row": row}).join(F.broadcast(starts), "__range").withColumn("__nth", F.col("__before") + F.col("__row"))
    small, large = F.floor(F.col("__all") / parts), F.col("__all") % parts
    first = large * (small + 1)
    number = F.when(F.col("__nth") < first, F.floor(F.col("__nth") / (small + 1))).otherwise(large + F.floor((F.col("__nth") - first) / F.greatest(small, F.lit(1))))
    return nth.select(*rows.columns, (number + 1).cast("int").alias("part"))

"""Frame series: dense spines, gap filling, rolling statistics, runs and debouncing.

All of them are windows over one session or track in frame order. ``keys`` name the
series and ``order`` its frame column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def spine(bounds: DataFrame, keys: list[str], low: str, high: str, order: str = "frame") -> DataFrame:
    """A row for every frame from low to high, both included."""
    return bounds.select(*keys, F.explode(F.sequence(F.col(low), F.col(high))).alias(order))


def densify(df: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """df with a row for every frame between a series' first and last; missing ones have nulls."""
    bounds = df.groupBy(*keys).agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    return spine(bounds, keys, "__low", "__high", order).join(df, [*keys, order], "left")


def fill_linear(
    df: DataFrame, keys: list[str], columns: list[str], order: str = "frame", limit: int | None = None, edges: str = "none"
) -> DataFrame:
    """Nulls of a dense series by linear interpolation between the nearest known values.

    edges: ``none`` leaves gaps before the first and after the last known value, ``clamp``
    repeats these values. limit: at most so many rows are filled from each side of a gap,
    so gaps up to twice the limit close and longer ones keep their middle.
    """
    before, after = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0), ordered(keys, order).rowsBetween(0, Window.unboundedFollowing)
    at = F.col(order)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), at)
        low, high = F.last(known, True).over(before), F.first(known, True).over(after)
        a, b = F.last(c, True).over(before), F.first(c, True).over(after)
        df = df.withColumns({"__low": low, "__high": high, "__a": a, "__b": b})
        inner = F.col("__a") + (F.col("__b") - F.col("__a")) * (at - F.col("__low")) / (F.col("__high") - F.col("__low"))
        value = F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("__low").isNotNull() & F.col("__high").isNotNull(), inner)
        if edges == "clamp":
            value = F.coalesce(value, "__a", "__b")
        if limit is not None:
            near = (at - F.col("__low") <= limit) | (F.col("__high") - at <= limit)
            value = F.when(F.col(c).isNotNull() | near, value)
        df = df.withColumn(c, value).drop("__low", "__high", "__a", "__b")
    return df


def rolling(df: DataFrame, keys: list[str], column: str, out: str, width: int, how: str = "mean", order: str = "frame") -> DataFrame:
    """Centred rolling mean or median over width rows, with what rows there are at the ends."""
    frame = ordered(keys, order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(out, (F.avg(column) if how == "mean" else F.percentile(column, 0.5)).over(frame))


def zero_padded_mean(df: DataFrame, keys: list[str], column: str, out: str, width: int, order: str = "frame") -> DataFrame:
    """Rolling sum over width rows, divided by width also where rows are missing at the ends."""
    frame = ordered(keys, order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.sum(column).over(frame) / F.lit(width))


def last_accepted(df: DataFrame, keys: list[str], value: str, accepted: Column, out: str, count: int = 7, order: str = "frame") -> DataFrame:
    """Median of the last ``count`` accepted values, at accepted rows; null elsewhere."""
    frame = ordered(keys, order).rowsBetween(-(count - 1), 0)
    some = df.where(accepted).withColumn(out, F.percentile(value, 0.5).over(frame)).select(*keys, order, out)
    return df.join(some, [*keys, order], "left")


def running_total(df: DataFrame, keys: list[str], column: str, out: str, order: str = "frame") -> DataFrame:
    return df.withColumn(out, F.sum(column).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: list[str], flag: Column, order: str = "frame", least: int = 1, steps: bool = True, more: tuple[Column, ...] = ()) -> DataFrame:
    """keys, start, end (last row of the run), length, and aggregates more, of runs in which flag holds.

    steps: rows that do not follow each other by one end a run.
    """
    where = ordered(keys, order)
    kept = df.withColumn("__n", F.row_number().over(where)).where(flag)
    mark = F.col(order) if steps else F.col("__n")
    kept = kept.withColumn("__run", mark - F.row_number().over(where))
    found = kept.groupBy(*keys, "__run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"), *more)
    return found.where(F.col("length") >= least).drop("__run")


def debounce(df: DataFrame, keys: list[str], column: str, out: str, none: int = -1, times: int = 3, order: str = "frame") -> DataFrame:
    """The last value that came ``times`` in a row and is not none; none before the first."""
    where = ordered(keys, order)
    same = F.col(column) != none
    for back in range(1, times):
        same = same & (F.lag(column, back).over(where) == F.col(column))
    stable = F.last(F.when(same, F.col(column)), True).over(where.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(stable, F.lit(none)))


def carry_forward(df: DataFrame, keys: list[str], column: str, out: str, order: str = "frame") -> DataFrame:
    """The last known value; before the first, the first known one."""
    where = ordered(keys, order)
    past, future = where.rowsBetween(Window.unboundedPreceding, 0), where.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.last(column, True).over(past), F.first(column, True).over(future)))


def inner_frames(df: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """df without the first and the last row of each series."""
    where = ordered(keys, order)
    marked = df.withColumns({"__before": F.lag(order).over(where), "__after": F.lead(order).over(where)})
    return marked.where("__before is not null and __after is not null").drop("__before", "__after")

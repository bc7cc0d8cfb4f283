"""Run-length masks and box suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import iou
from touchline.operators.groups import starts, whole_groups


def rle_area(counts: Column) -> Column:
    """Pixels of a mask whose runs alternate, background first."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def rle_encode(pixels: DataFrame, keys: list[str], order: str = "pos", value: str = "on") -> DataFrame:
    """counts of runs along pos (from 0, without gaps), background first, of 0 or 1 pixels."""
    where = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(value) != F.lag(value, 1, 0).over(where), 1).otherwise(0)
    marked = pixels.withColumn("__change", change)
    run = F.sum("__change").over(where.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("__run", run).groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__run", "n"))).alias("runs"))
    lead = F.when(F.col("runs")[0]["__run"] == 0, F.array().cast("array<long>")).otherwise(F.array(F.lit(0).cast("long")))
    return runs.select(*keys, F.concat(lead, F.transform("runs", lambda r: r["n"])).alias("counts"))


def mask_box(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around the pixels (px, py) of a mask."""
    return pixels.groupBy(*keys).agg(F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"))


def suppress(boxes: DataFrame, keys: list[str], threshold: float = 0.7) -> DataFrame:
    """Greedy non-maximum suppression of boxes (box_id, x1, y1, x2, y2, score) within each group; a group is one frame.

    The boxes of a frame are folded from the best to the worst; one that overlaps a kept one too much is left out.
    """
    order = [(-F.col("score")).alias("less"), "box_id", "x1", "y1", "x2", "y2", *(c for c in boxes.columns if c not in {*keys, "box_id", "x1", "y1", "x2", "y2"})]
    held = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("boxes"))

    def overlaps(one: Column, other: Column) -> Column:
        return iou([one[c] for c in ("x1", "y1", "x2", "y2")], [other[c] for c in ("x1", "y1", "x2", "y2")]) > threshold

    def step(kept: Column, box: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlaps(k, box)), kept).otherwise(F.concat(kept, F.array(box)))

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), step)
    return held.select(*keys, F.inline(kept)).select(*boxes.columns)


def point_grid(spark, n: int) -> DataFrame:
    """n by n points at the centres of equal cells of the unit square."""
    side = spark.range(n).select(((F.col("id") + 0.5) / n).alias("v"))
    return side.select(F.col("v").alias("x"), F.explode(F.array(*(F.lit((i + 0.5) / n) for i in range(n)))).alias("y"))


def decode_runs(counts: Column) -> Column:
    """A run-length encoded mask as text of 0 and 1; runs start with 0."""
    return F.array_join(F.transform(counts, lambda n, i: F.repeat(F.when(i % 2 == 1, "1").otherwise("0"), n.cast("int"))), "")


SPAN = 1 << 32  # more than any column


def label_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Component of each run of pixels (row, first and last column, apart from each other and sorted by row and column): the smallest index of its runs.

    Runs that touch one of the row below, also at a corner, are found by bisection; then the smaller of two roots takes
    over the larger one until all links lie within a component.
    """
    root = np.arange(len(row))
    low = np.searchsorted(row * SPAN + last, (row + 1) * SPAN + first - 1)
    high = np.searchsorted(row * SPAN + first, (row + 1) * SPAN + last + 1, side="right")
    touching = np.maximum(high - low, 0)
    a = np.repeat(root, touching)
    b = np.arange(len(a)) + np.repeat(low - (np.cumsum(touching) - touching), touching)
    while len(a):
        one, two = root[a], root[b]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _join_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted, with those that touch or overlap in a row made one."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    reach = np.maximum.accumulate(last + row * SPAN) - row * SPAN if len(row) else last
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (first[1:] > reach[:-1] + 1)
    at = np.nonzero(opens)[0]
    return row[at], first[at], np.maximum.reduceat(last, at) if len(at) else last


def _holes(row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the pixels of the given rows of an image that are in no run."""
    starts, owner = np.append(np.zeros(len(rows), np.int64), last + 1), np.append(rows, row)
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    opens, ender = np.append(first, np.full(len(rows), width)), np.append(row, rows)
    ends = opens[np.lexsort((opens, ender))] - 1
    some = ends >= starts
    return owner[some], starts[some], ends[some]


RUN = ["row", "first", "last"]


def _stack(mask: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of many masks as rows of one tall image, and the mask and row that each of its rows stands for.

    Rows that follow each other in a mask do so in the image; a free row lies between all others.
    """
    order = np.lexsort((row, mask))
    own, at = mask[order], row[order]
    step = np.full(len(order), 2)
    step[1:] = np.where(own[1:] == own[:-1], np.minimum(at[1:] - at[:-1], 2), 2)
    number = np.cumsum(step)
    placed = np.empty(len(order), np.int64)
    placed[order] = number
    of_mask, of_row = np.zeros((2, number[-1] + 1), np.int64)
    of_mask[number], of_row[number] = own, at
    return placed, of_mask, of_row


def _masks(runs: DataFrame, keys: list[str], work, more: str, height: int = 0) -> DataFrame:
    """work(row, first, last, of_mask, rows) on the joined runs of many masks below each other (_stack()); its columns besides the runs' follow ``more``.

    of_mask: the number of the mask of each row of the tall image; rows: its rows that stand for the first ``height`` of each mask.
    """

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        heads = starts(frame, keys)
        n = len(heads)
        row, first, last = (frame[c].to_numpy(np.int64) for c in RUN)
        mask = np.append(np.repeat(np.arange(n), np.diff(np.append(heads, len(frame)))), np.repeat(np.arange(n), height))
        placed, of_mask, of_row = _stack(mask, np.append(row, np.tile(np.arange(height), n)))
        found = work(*_join_runs(placed[: len(frame)], first, last), of_mask, placed[len(frame) :])
        out = frame[keys].iloc[heads[of_mask[found["row"]]]].reset_index(drop=True)
        return out.assign(**{**found, "row": of_row[found["row"]]})

    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
    return whole_groups(runs, keys, [], each, f"{kinds}, row long, first long, last long{more}")


def components(runs: DataFrame, keys: list[str]) -> DataFrame:
    """row, first, last and component of the joined runs of each mask; a component is numbered by its first run. Diagonal neighbours touch.

    runs: keys, row, first, last column. Many masks are worked on at a time; the runs of one are held at once, which its image bounds.
    """

    def work(row, first, last, of_mask, rows):
        mask = of_mask[row]
        return {"row": row, "first": first, "last": last, "component": label_runs(row, first, last) - np.searchsorted(mask, mask)}

    return _masks(runs, keys, work, ", component long")


def component_boxes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Area and box of each component."""
    area = F.sum(F.col("last") - F.col("first") + 1)
    box = [F.min("first").alias("x1"), F.min("row").alias("y1"), F.max("last").alias("x2"), F.max("row").alias("y2")]
    return labelled.groupBy(*keys, "component").agg(area.alias("area"), *box)


def without_small(runs: DataFrame, keys: list[str], most: int, width: int, height: int) -> DataFrame:
    """Runs of masks in which holes of fewer than ``most`` pixels are filled and then islands of fewer go, and whether a mask changed.

    The largest island stays where all are small. A mask without pixels has no rows.
    """

    def areas(row, first, last):
        named = label_runs(row, first, last)
        area = np.zeros(len(row), np.int64)
        np.add.at(area, named, last - first + 1)
        return named, area

    def work(row, first, last, of_mask, rows):
        n = of_mask[-1] + 1
        gaps = _holes(row, first, last, width, rows)
        named, area = areas(*gaps)
        small = area[named] < most
        filled = _join_runs(*(np.append(own, gap[small]) for own, gap in zip((row, first, last), gaps, strict=True)))
        named, area = areas(*filled)
        keep, mask = area[named] >= most, of_mask[filled[0]]
        # The largest island of each mask, of equal ones the first.
        roots = np.nonzero(named == np.arange(len(named)))[0]
        roots = roots[np.lexsort((-area[roots], mask[roots]))]
        largest = roots[np.searchsorted(mask[roots], np.arange(n))]
        keep |= (np.bincount(mask[keep], minlength=n) == 0)[mask] & (named == largest[mask])
        changed = (np.bincount(of_mask[gaps[0][small]], minlength=n) > 0) | (np.bincount(mask[~keep], minlength=n) > 0)
        kept = [c[keep] for c in filled]
        return {"row": kept[0], "first": kept[1], "last": kept[2], "changed": changed[mask[keep]]}

    return _masks(runs, keys, work, ", changed boolean", height)


def cleaned_boxes(runs: DataFrame, frame: list[str], mask: str, most: int, width: int, height: int, threshold: float = 0.7) -> DataFrame:
    """Boxes of the masks of each frame without small regions, of overlapping ones the better: a mask that did not change before one that did, then the first by number.

    Columns: frame's, box_id (the mask), x1, y1, x2, y2, score (1 unchanged, 0 changed).
    """
    kept = without_small(runs, [*frame, mask], most, width, height)
    box = [F.min("first").alias("x1"), F.min("row").alias("y1"), F.max("last").alias("x2"), F.max("row").alias("y2")]
    boxes = kept.groupBy(*frame, F.col(mask).alias("box_id")).agg(*box, F.min(F.when(F.col("changed"), 0.0).otherwise(1.0)).alias("score"))
    return suppress(boxes, frame, threshold)


def layered_grid(images: DataFrame, keys: list[str], n: int, layers: int, scale: int) -> DataFrame:
    """layer, x, y of prompt points in each image (width, height): cell centres of a grid of n // scale ** layer a side, in pixels."""
    sides = F.array(*(F.struct(F.lit(i).alias("layer"), F.lit(n // scale**i).alias("side")) for i in range(layers + 1) if n // scale**i))
    dealt = images.select(*keys, "width", "height", F.inline(sides))
    cells = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    x, y = (F.col("i") + 0.5) / F.col("side") * F.col("width"), (F.col("j") + 0.5) / F.col("side") * F.col("height")
    return cells.select(*keys, "layer", x.alias("x"), y.alias("y"))

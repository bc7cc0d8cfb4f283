"""Masks in runs against flood fill on pixels, the keyed store, and smooth densities."""

import math
import random
import uuid

import pandas as pd
from pyspark.sql import functions as F

from touchline.operators import features, groups, masks, targets
from touchline.sources import keyed
from touchline.sources.folders import shared_folder

WIDTH, HEIGHT = 14, 9


def regions(pixels):
    """Sets of pixels that touch, also at corners."""
    left, out = set(pixels), []
    while left:
        queue, own = [left.pop()], set()
        while queue:
            y, x = queue.pop()
            own.add((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            queue += near
        out.append(own)
    return out


def random_masks(spark, n=12):
    rng = random.Random(9)
    pixels = {m: {(y, x) for y in range(HEIGHT) for x in range(WIDTH) if rng.random() < 0.2 + 0.05 * m} | {(0, 0)} for m in range(n)}
    runs = []
    for m, own in pixels.items():
        for y, x in own:
            wide = rng.choice([0, 0, 1]) if (y, x + 1) in own else 0
            runs.append((m % 3, m, y, x, x + wide))  # runs of a pixel or two, in no order, some of which overlap
    rng.shuffle(runs)
    return pixels, spark.createDataFrame(runs, "frame long, mask long, row int, first int, last int")


def pixels_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["mask"], {}).setdefault(r["component"] if "component" in r else 0, set()).update((r["row"], x) for x in range(r["first"], r["last"] + 1))
    return out


def test_components(spark):
    pixels, runs = random_masks(spark)
    found = pixels_of([r.asDict() for r in masks.components(runs, ["frame", "mask"]).collect()])
    for m, own in pixels.items():
        assert sorted(map(sorted, found[m].values())) == sorted(map(sorted, regions(own)))


def test_small_regions_go(spark):
    pixels, runs = random_masks(spark)
    rows = [r.asDict() for r in masks.without_small(runs, ["frame", "mask"], 4, WIDTH, HEIGHT).collect()]
    found, changed = pixels_of(rows), {r["mask"]: r["changed"] for r in rows}
    every = {(y, x) for y in range(HEIGHT) for x in range(WIDTH)}
    for m, own in pixels.items():
        filled = own.union(*(hole for hole in regions(every - own) if len(hole) < 4))
        islands = regions(filled)
        kept = [i for i in islands if len(i) >= 4] or [max(islands, key=len)]
        assert found[m][0] in (set().union(*kept), *kept) and len(found[m][0]) == sum(map(len, kept))
        assert changed[m] == (found[m][0] != own)


def test_unchanged_masks_win_the_second_suppression(spark):
    square = [(0, m, y, x, x) for m in (1, 2) for y in range(5) for x in range(5) if m == 2 or (y, x) != (2, 2)]
    runs = spark.createDataFrame(square, "frame long, mask long, row int, first int, last int")
    assert [r["box_id"] for r in masks.cleaned_boxes(runs, ["frame"], "mask", 3, 10, 10).collect()] == [2]  # mask 1 had a hole


def test_upsert_leaves_other_buckets_alone(spark):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    rows = spark.range(200).select("id", F.lit(0).alias("version"), F.lit("a").alias("state"))
    keyed.create(rows, path, ["id"], 16)

    def files():
        return {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}

    before = files()
    changes = spark.createDataFrame([(3, 2, "c"), (3, 1, "b"), (999, 1, "new")], "id long, version int, state string")
    assert keyed.upsert(changes, path, ["id"], 16, [F.desc("version")]) <= 2
    assert len(before & files()) >= 14
    found = {r["id"]: r["state"] for r in keyed.read(spark, path).collect()}
    assert len(found) == 201 and found[3] == "c" and found[999] == "new" and found[4] == "a"
    assert keyed.upsert(changes.limit(0), path, ["id"], 16, [F.desc("version")]) == 0


def test_smooth_heat_is_the_two_dimensional_kernel(spark):
    cells = {(0, 0): 3, (2, 1): 1, (40, 40): 2}
    table = spark.createDataFrame([(1, x, y, n) for (x, y), n in cells.items()], "session_id long, cell_x long, cell_y long, n long")
    w = features.gaussian(9)
    assert math.isclose(sum(features.gaussian(101)), 1) and features.gaussian(101)[50] > features.gaussian(101)[40]
    for r in features.smooth_heat(table, ["session_id"], 9).collect():
        near = [(x, y, n) for (x, y), n in cells.items() if abs(r["cell_x"] - x) <= 4 and abs(r["cell_y"] - y) <= 4]
        assert math.isclose(r["density"], sum(n * w[r["cell_x"] - x + 4] * w[r["cell_y"] - y + 4] for x, y, n in near))


def test_boxes_of_many_sessions_share_files(spark):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    lines = spark.range(900, numPartitions=3).select(F.col("id").alias("s"), F.concat_ws(",", "id", F.lit("1,2,3,4,5")).alias("value"))
    targets.write_keyed(lines.unionByName(lines.limit(1).withColumn("value", F.lit("7,1,2"))), path, ["s"])
    assert spark.read.text(path).select(F.input_file_name()).distinct().count() <= 4
    found = targets.read_keyed(spark, path, {"s": "long"}).orderBy("s").collect()
    assert [tuple(r) for r in found] == [(i, 10 * i, 1, 2.0, 3.0, 4.0, 5.0) for i in range(900)]


def test_masks_and_tracks_come_many_a_call(spark):
    """Groups that end within a batch of rows, groups that span batches, and null keys; a call has more than one group."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "50")
    try:
        rows = spark.range(3000).select(F.when(F.col("id") >= 200, F.floor(F.col("id") / F.when(F.col("id") < 2000, 3).otherwise(400))).alias("k"), "id")
        work = lambda frame: pd.DataFrame({"groups": [len(groups.starts(frame, ["k"]))], "rows": [len(frame)]})
        found = groups.whole_groups(rows, ["k"], ["id"], work, "groups long, rows long").agg(F.sum("groups"), F.sum("rows"), F.count("*")).first()
        assert found[0] == rows.select("k").distinct().count() and found[1] == 3000 and found[2] < found[0] / 3
        one = spark.createDataFrame([(None if m % 9 == 0 else m % 9, m, y, x, x) for m in range(40) for y in range(9) for x in (0, 1, 3 + y % 2, 9)], "frame long, mask long, row int, first int, last int")
        found = masks.component_boxes(masks.components(one, ["frame", "mask"]), ["frame", "mask"]).collect()
        assert sorted((r["mask"], r["x1"], r["x2"], r["area"]) for r in found) == sorted((m, *b) for m in range(40) for b in ((0, 1, 18), (3, 4, 9), (9, 9, 9)))
    finally:
        spark.conf.set(size, before)

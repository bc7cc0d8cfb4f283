"""Laid-out scans, binned range joins, the change source and streams with state."""

import random
import uuid
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import features, matching
from touchline.operators.stateful import kalman_path
from touchline.plans import live, tracking
from touchline.sources import changes, frames
from touchline.sources.folders import shared_folder
from touchline.streaming import stateful, windows

SF_DIR = "/root/testdata/sf0.001"


def new_folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def scanned_rows(df):
    """Rows that the file scan of a plan without exchanges gave to the rest of it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_scans_reach_the_row_groups(spark):
    path = new_folder(spark)
    rows = spark.range(200_000).select((F.col("id") % 10).alias("session_id"), F.floor(F.col("id") / 10).alias("frame"), F.rand(1).alias("x"))
    frames.lay_out(rows, path, buckets=4, **{"parquet.block.size": 65536, "parquet.page.size": 8192})
    found = frames.scan(spark, path, 5000, 5100, 7, sessions=[3, 8], buckets=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(frame,5000)" in plan and "LessThan(frame,5100)" in plan and "In(session_id, [3,8])" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert sorted((r["session_id"], r["frame"]) for r in found.collect()) == sorted((s, f) for s in (3, 8) for f in range(5000, 5100, 7))
    assert scanned_rows(frames.scan(spark, path, 5000, 5100, 7, sessions=[3, 8], buckets=4)) < 40_000
    assert frames.scan(spark, path).count() == 200_000 and frames.scan(spark, path, sessions=[77]).count() == 0


def test_first_range_against_brute_force(spark):
    rng = random.Random(5)
    asked = [(s, a, a + rng.choice([0, 1, 2, 5, 40, 300]), i) for i, (s, a) in enumerate((rng.randint(0, 2), rng.randint(-50, 400)) for _ in range(120))]
    spots = [(s, f) for s in range(3) for f in range(-60, 500)] * 2
    got = matching.first_range(
        spark.createDataFrame(spots, "session_id long, frame int"), spark.createDataFrame(asked, "session_id long, start_frame int, end_frame int, number int"), ["session_id"]
    ).collect()
    want = []
    for s, f in spots:
        held = min(((a, b, n) for t, a, b, n in asked if t == s and a <= f < b), default=None)
        if held:
            want.append((s, f, *held))
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "session_id long, start_frame int, end_frame int, number int")
    assert matching.first_range(spark.createDataFrame(spots, "session_id long, frame int"), none, ["session_id"]).count() == 0


def test_change_source_gives_each_row_once(spark):
    """Two runs with one checkpoint, a third turn that isn't whole yet, and a filter."""
    folder = new_folder(spark)
    changes.register(spark)
    rows = spark.range(30).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("line"))

    def stream():
        feed = spark.readStream.format(changes.NAME).schema(rows.schema).options(path=f"{folder}/in", key="session_id", value="2").load()
        return windows.copy_stream(feed, f"{folder}/checkpoint", f"{folder}/out")

    windows.in_turns([rows.where("line < 10"), rows.where("line between 10 and 19")], f"{folder}/in", stream)
    rows.where("line >= 20").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/in/turn=2")
    stream().awaitTermination()
    assert sorted(r["line"] for r in spark.read.parquet(f"{folder}/out").collect()) == [x for x in range(20) if x % 3 == 2]


def test_streamed_filter_equals_the_whole_series(spark):
    whole = {(r["session_id"], r["frame"]): r for r in tracking.kalman_track(spark, SF_DIR).collect()}
    parts = live.kalman_streamed(spark, SF_DIR).collect()
    assert len(parts) == len(whole)
    for r in parts:
        other = whole[r["session_id"], r["frame"]]
        for c in ("cx", "cy", "aspect", "h", "gate"):
            a, b = r[c], other[c]
            assert (a is None or a != a) == (b is None or b != b)
            if a is not None and a == a:
                assert abs(a - b) <= 1e-6 * max(1, abs(b))


def test_sprints_of_the_reference_cases(spark):
    """A frame faster than the sprint, a session without sprints, a run with one known position, a run that reaches the end."""
    rows = [(1, f, 30.0 if 2 <= f < 6 else 33.0 if f == 9 else 5.0, True) for f in range(12)]
    rows += [(2, f, 7.04, True) for f in range(4)] + [(3, f, 26.0, f == 0) for f in range(5)] + [(4, f, 26.0 if f > 1 else None, True) for f in range(5)]
    samples = spark.createDataFrame(rows, "session_id long, frame int, speed double, located boolean")
    found = features.sprint_analysis(samples, ["session_id"], 1.0, located=F.col("located")).orderBy("session_id").collect()
    assert [tuple(r) for r in found] == [(1, 1, 3.0, 3.0, 33.0), (2, 0, 0.0, 0.0, 7.0), (3, 0, 0.0, 0.0, 26.0), (4, 1, 2.0, 2.0, 26.0)]


def test_switches_across_chunks_and_restarts(spark):
    """A batch holds the state of all sessions, also of those that it doesn't change; frames without a team leave the state as it is."""
    folder = new_folder(spark)
    teams = [{1: [1, 0, 2], 2: [0, 0]}, {1: [0, 2]}, {1: [1], 2: [2, 1], 3: [1, 1]}]
    rows = [[(s, f"{k}-{i}", t) for s, own in chunk.items() for i, t in enumerate(own)] for k, chunk in enumerate(teams)]
    kinds = "session_id long, at string, team int"

    def stream():
        return windows.carried_switches(spark.readStream.schema(kinds).parquet(f"{folder}/in/turn=*"), f"{folder}/checkpoint", f"{folder}/out")

    windows.in_turns([spark.createDataFrame(r, kinds) for r in rows], f"{folder}/in", stream)
    batches = [sorted(map(tuple, spark.read.parquet(f"{folder}/out/batch={k}").collect())) for k in range(3)]
    assert batches[0] == [(1, 3, 1, 2), (2, 2, 0, 0)] and batches[1] == [(1, 5, 1, 2), (2, 2, 0, 0)]
    assert batches[2] == [(1, 6, 2, 1), (2, 4, 1, 1), (3, 2, 0, 1)]


def test_series_keep_their_filters_in_few_groups(spark):
    """Series of one group, one without a box so far and one that starts later, carried over two turns."""
    folder, kinds = new_folder(spark), "s long, at timestamp, frame int, cx double, cy double, aspect double, h double"
    rows = [(s, datetime(2020, 1, 1, 0, f), f, *((10.0 * f + s, 5.0 * f, 0.5, 100.0) if f >= s and (f + s) % 3 else (None,) * 4)) for s in (0, 4, 9) for f in range(12) if f >= 6 or s != 9]

    def stream():
        return stateful.kalman_stream(spark.readStream.schema(kinds).parquet(f"{folder}/in/turn=*"), "s", f"{folder}/checkpoint", f"{folder}/out", groups=1)

    windows.in_turns([spark.createDataFrame([r for r in rows if (r[2] >= 4) == late], kinds) for late in (False, True)], f"{folder}/in", stream)
    found = {(r["s"], r["frame"]): r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert len(found) == len(rows)
    for s in (0, 4, 9):
        own = [r for r in rows if r[0] == s]
        path, gate = kalman_path(np.array([r[3:] for r in own], float))
        got = [[found[s, r[2]][c] for c in ("cx", "cy", "aspect", "h", "gate")] for r in own]
        assert np.allclose(np.array(got, float), np.column_stack([path, gate]), equal_nan=True)

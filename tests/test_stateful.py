"""Folds over frames on known cases."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import geometry, text
from touchline.operators import masks, series, stateful


def frames(balls, players):
    return [((x, y, float("nan"), float("nan")), players) for x, y in balls]


def test_controlled_ball():
    player = [(1, 100.0, 200.0, 50.0, float("nan"), float("nan"))]
    found = stateful.possession_of(frames([(100, 195)] * 6, player), 1.0)
    assert found[-1][:2] == (1, "controlled") and found[-1][3]
    assert not found[0][3]  # the first frames after a switch are neutral


def test_loose_ball():
    player = [(1, 900.0, 920.0, 50.0, float("nan"), float("nan"))]
    found = stateful.possession_of(frames([(100, 100)] * 6, player), 1.0)
    assert found[-1][:2] == (-1, "loose_ball") and not found[-1][3]


def test_flying_ball():
    player = [(1, 100.0, 200.0, 50.0, float("nan"), float("nan"))]
    found = stateful.possession_of(frames([(100, 100 + 50 * i) for i in range(5)], player), 1.0)
    assert found[-1][1] == "flying" and not found[-1][3]


def test_frame_without_ball_leaves_the_state():
    player = [(1, 100.0, 200.0, 50.0, float("nan"), float("nan"))]
    found = stateful.possession_of([*frames([(100, 195)] * 5, player), (None, player)], 1.0)
    assert found[-1][0] == -1 and found[-1][1] == "controlled"


def test_spline_midpoint_and_cubic():
    assert stateful.natural_fill(np.array([5.0]), np.array([0.0, 10.0]), np.array([100.0, 200.0]))[0] == 150
    known = np.array([0.0, 3.0, 5.0, 9.0, 12.0])
    cubic = lambda x: x**3 - 2 * x**2 + 3
    at = np.arange(13.0)
    assert np.allclose(stateful.natural_fill(at, known, cubic(known)), cubic(at))


def test_kalman_follows_a_straight_line():
    boxes = np.array([[10.0 * i, 5.0 * i, 0.5, 100.0] for i in range(30)])
    boxes[20] = np.nan
    path, gate = stateful.kalman_path(boxes)
    assert np.allclose(path[-1], boxes[-1], atol=2.0) and abs(path[20][0] - 200) < 5 and np.isnan(gate[20])


def test_homography_is_recovered():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 1000, 12), rng.uniform(0, 700, 12)
    h = np.array([[8.0, 1.0, 100.0], [0.5, 9.0, 50.0], [1e-4, 2e-4, 1.0]])
    m = h @ np.stack([x, y, np.ones(12)])
    assert np.allclose(stateful.fit_homography(x, y, m[0] / m[2], m[1] / m[2]).reshape(3, 3), h, rtol=1e-4)


def test_greedy_tracks_follow_boxes(spark):
    rows = [("s", f, 10.0 * f + o, 0.0, 10.0 * f + o + 50, 50.0, 0.9 - o / 1000) for f in range(6) for o in (0, 300)]
    found = stateful.greedy_tracks(spark.createDataFrame(rows, "session_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double"), ["session_id"])
    ids = found.groupBy("track_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in ids) == [6, 6]


def test_limited_fill(spark):
    values = [1, None, None, None, None, None, None, 8]
    df = spark.createDataFrame([("s", i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, frame int, v double")
    found = [r["v"] for r in series.fill_linear(df, ["k"], ["v"], limit=2).orderBy("frame").collect()]
    assert found == [1, 2, 3, None, None, 6, 7, 8]


def test_zero_padded_window(spark):
    df = spark.createDataFrame([("s", i, 1.0 if i == 5 else 0.0) for i in range(12)], "k string, frame int, v double")
    for width, wanted in ((4, [4, 5, 6, 7]), (5, [3, 4, 5, 6, 7])):
        rows = series.zero_padded_mean(df, ["k"], "v", "m", width).where("m > 0").collect()
        assert sorted(r["frame"] for r in rows) == wanted


def test_colours_clamp_and_names(spark):
    df = spark.createDataFrame([(0, 0, 255, -5.0, 75.0, "../a b*c?.MP4")], "b int, g int, r int, x double, y double, n string")
    r = df.select(
        text.colour_to_hex(F.col("b"), F.col("g"), F.col("r")).alias("hex"), geometry.clamp(F.col("x"), 120.0).alias("x"), geometry.clamp(F.col("y"), 70.0).alias("y"),
        text.safe_filename(F.col("n")).alias("n"), text.allowed_extension(F.col("n")).alias("ok"),
    ).collect()[0]
    assert tuple(r) == ("#ff0000", 0.0, 70.0, "a b_c_.MP4", True)


def test_suppression_keeps_the_best(spark):
    rows = [("s", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("s", 2, 1.0, 0.0, 11.0, 10.0, 0.8), ("s", 3, 50.0, 0.0, 60.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, "k string, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r["box_id"] for r in masks.suppress(df, ["k"]).collect()) == [1, 3]


def test_possession_table(spark):
    rows = [("s", f, o, i, p, q, np.nan, np.nan, q - 50, q, 1) for f in range(6) for o, i, p, q in (("ball", 9, 100.0, 195.0), ("player", 1, 100.0, 200.0))]
    frame = pd.DataFrame(rows, columns=["session_id", "frame", "obj", "track_id", "px", "py", "tx", "ty", "y1", "y2", "team"])
    found = stateful.possession(spark.createDataFrame(frame), ["session_id"]).orderBy("frame").collect()
    assert found[-1]["team"] == 1 and found[0]["team"] == 0
    assert found[-1]["confidence"] == pytest.approx(0.9)


def test_stacked_filter_is_the_filter_of_each_series():
    """Against the textbook equations, one series and one step at a time."""
    rng = np.random.default_rng(5)
    series_ = rng.normal([500, 300, 0.4, 100], [40, 40, 0.02, 4], (5, 25, 4))
    series_[rng.random((5, 25)) < 0.3] = np.nan
    series_[3, :4] = np.nan
    paths, gates = stateful.kalman_paths(series_)
    move = np.eye(8) + np.eye(8, k=4)
    for boxes, path, gate in zip(series_, paths, gates, strict=True):
        mean = cov = None
        for i, z in enumerate(boxes):
            if mean is not None:
                h = mean[3]
                noise = np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2
                mean, cov = move @ mean, move @ cov @ move.T + np.diag(noise)
            if not np.isnan(z).any() and mean is None:
                h = z[3]
                mean, cov = np.append(z, np.zeros(4)), np.diag(np.array([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2)
            elif not np.isnan(z).any():
                s = cov[:4, :4] + np.diag(np.array([mean[3] / 20, mean[3] / 20, 1e-1, mean[3] / 20]) ** 2)
                off = z - mean[:4]
                assert abs(off @ np.linalg.inv(s) @ off - gate[i]) < 1e-6
                gain = cov[:, :4] @ np.linalg.inv(s)
                mean, cov = mean + gain @ off, cov - gain @ s @ gain.T
            assert np.isnan(path[i]).all() if mean is None else np.allclose(path[i], mean[:4])


def test_spline_sweep_matches_the_whole_system_and_is_linear():
    rng = np.random.default_rng(6)
    for n in (4, 5, 9, 40):
        known = np.cumsum(rng.integers(1, 9, n)).astype(float)
        values = rng.normal(0, 50, n)
        h, system, right = np.diff(known), np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((values[i + 1] - values[i]) / h[i] - (values[i] - values[i - 1]) / h[i - 1])
        system[0, :3], system[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
        second = np.linalg.solve(system, right)
        k = n // 2 - 1
        middle = (known[k] + known[k + 1]) / 2
        wanted = (values[k] + values[k + 1]) / 2 - h[k] ** 2 * (second[k] + second[k + 1]) / 16
        assert abs(stateful.natural_fill(np.array([middle]), known, values)[0] - wanted) < 1e-6
    known = np.arange(0, 300_000, 2, dtype=float)
    assert np.isfinite(stateful.natural_fill(np.arange(300_000.0), known, np.sin(known / 50))).all()


def test_kalman_groups_and_homographies_of_sessions(spark):
    rows = [(s, f, *((10.0 * f + s, 5.0 * f, 0.5, 100.0) if f % 3 or not f else (None,) * 4)) for s in range(7) for f in range(5 + 3 * s)]
    measures = spark.createDataFrame(rows, "session_id long, frame int, cx double, cy double, aspect double, h double")
    found = {(r["session_id"], r["frame"]): r for r in stateful.kalman_track(measures, ["session_id"], group_rows=8).collect()}
    for s in range(7):
        boxes = np.array([r[2:] for r in rows if r[0] == s], float)
        path, _ = stateful.kalman_path(boxes)
        assert np.allclose([[found[s, f][c] for c in ("cx", "cy", "aspect", "h")] for f in range(len(boxes))], path)
    rng = np.random.default_rng(0)
    points = []
    for f in range(4):
        for x, y in rng.uniform(0, 1000, (10 if f else 3, 2)):
            points.append((1, f, float(x), float(y), float(8 * x + 100), float(7 * y + 50)))
    table = spark.createDataFrame(points, "session_id long, frame int, x double, y double, u double, v double")
    fitted = {r["frame"]: r for r in stateful.homographies(table, ["session_id"]).collect()}
    assert sorted(fitted) == [1, 2, 3] and all(abs(r["h0"] - 8) < 1e-6 and abs(r["h5"] - 50) < 1e-3 for r in fitted.values())


def test_tracker_matches_a_plain_greedy_one(spark):
    rng = np.random.default_rng(3)
    rows = [(1, f, int(i), float(200 * i + 6 * f + rng.integers(0, 5)), 10.0, float(200 * i + 6 * f + 100), 110.0, float(rng.random())) for f in range(12) for i in range(4) if rng.random() < 0.9]
    table = spark.createDataFrame(rows, "session_id long, frame int, own int, x1 double, y1 double, x2 double, y2 double, conf double")
    found = stateful.greedy_tracks(table, ["session_id"]).collect()
    names = {}
    for r in found:  # boxes that never touch another's keep one number
        names.setdefault(r["own"], set()).add(r["track_id"])
    assert len(found) == len(rows) and all(len(n) == 1 for n in names.values()) and len({min(n) for n in names.values()}) == 4


def test_tracker_with_hundreds_of_live_tracks(spark):
    """A long patience keeps all tracks of boxes that never meet again; pairs of boxes and tracks are looked at as arrays, not one by one."""
    rng = np.random.default_rng(8)
    rows = [(1, f, float(x), float(y), float(x + 60), float(y + 60), float(c)) for f in range(300) for x, y, c in zip(*rng.uniform(0, 9000, (2, 22)), rng.random(22), strict=True)]
    table = spark.createDataFrame(rows, "session_id long, frame int, x1 double, y1 double, x2 double, y2 double, conf double")
    stateful.greedy_tracks(table.limit(5), ["session_id"]).collect()
    start = time.time()
    found = stateful.greedy_tracks(table, ["session_id"], patience=1000).groupBy("track_id").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in found) == 6600 and 3000 < len(found) < 6600 and time.time() - start < 15

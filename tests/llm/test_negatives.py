import random

import pytest
from pyspark.sql import functions as F

from touchline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label long, id string, vec string, score string, slot string"


def brute_force(rows, every=7):
    """Hard negatives of rows (id, whole vector, label) whose id is divisible by ``every``."""
    best = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = set()
    for a, (own, v) in best.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, label) for i, (label, w) in best.items() if i != a)
        for s, p in [(-s, i) for s, i, label in ranked if label == own][:5]:
            hard = [(-n, i) for n, i, label in ranked if label != own and 50 * s <= -100 * n <= 95 * s][:3]
            out |= {(a, p, k, i, s, n) for k, (n, i) in enumerate(hard, 1)}
    return out


def found(spark, rows, every=7):
    table = spark.createDataFrame([(i, None if v is None else [x / 256 for x in v], label, "x", "x", "x", "x") for i, v, label in rows], SCHEMA)
    out = [tuple(r) for r in negatives.mine(table, F.col("vec_id") % every == 0).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("block", [negatives.BLOCK, 16])
def test_against_brute_force(spark, monkeypatch, block):
    """Clusters, a third of all rows one vector, ties, and blocks of a few rows and anchors."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", block // 4)
    rng = random.Random(block)
    centres = [[rng.randint(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.randint(-25, 25) for x in centres[i % 5]] if i % 3 else [40, 3, -7, 30, 1, 0], rng.randint(0, 3)) for i in range(400)]
    assert found(spark, rows) == brute_force(rows)


def test_hard_rows(spark):
    """Nulls, no components, unequal lengths, zero vectors, negative scores, repeated ids, a label on its own."""
    rows = [(0, [3, 4], 1), (0, [3, 4], 1), (0, [1, 1], 2), (None, [5, 5], 1), (1, None, 1), (2, [3, 4, 9], 1), (3, [2, 2], None), (4, [], 2)]
    rows += [(7, [0, 0], 1), (8, [2, 3], 2), (9, [2, 3], 3), (14, [-3, -4], 1), (10, [3, 2], 2), (21, [6, 1], 9)]
    assert found(spark, rows) == brute_force(rows)
    odd = spark.createDataFrame([(0, [1.0, float("nan")], 1), (7, [1.0, None], 1), (14, [float("inf"), 1.0], 1)], "vec_id long, embedding array<double>, label long")
    assert negatives.mine(odd, F.col("vec_id") % 7 == 0).count() == 0
    assert negatives.mine(odd.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_annuli_are_scanned_instead_of_everything(spark):
    """Far clusters of another label are outside of the annuli that certify the nearest rows."""
    rows = [(i, [1000 + i % 9, i % 7, 3], i % 2) for i in range(300)] + [(300 + i, [-5000 + i % 5, i % 3, -900], i % 2) for i in range(300)]
    table = spark.createDataFrame([(i, v, label) for i, v, label in rows], "id long, vec array<long>, label long")
    space = negatives.fit_space(table)
    blocks, ranges = negatives.build_index(table, space)
    assert sum(r["n"] for r in blocks.select("n").collect()) == 600
    import numpy as np

    anchor = np.array([[1004, 3, 3]])
    to = space.keys(anchor, np.zeros(1))[0]
    reach = space.radius((anchor**2).sum(1).astype(float), np.array([1000.0 * 1004]))[0]
    met = [r["n"] for r in blocks.select("pivot", "lo", "hi", "n").collect() if r["lo"] <= to[r["pivot"]] + reach and r["hi"] >= to[r["pivot"]] - reach]
    assert 300 <= sum(met) < 600

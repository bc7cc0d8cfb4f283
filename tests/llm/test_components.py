import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import union_find
from touchline.llm import common, lines


def graph(seed, nodes=300, edges=260):
    rng = random.Random(seed)
    path = [(i, i + 1) for i in range(1000, 1040)]
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + path


def expected(pairs):
    pairs = [p for p in pairs if p[0] != p[1]]
    return union_find({x for p in pairs for x in p}, pairs)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("few", [0, 60, 10_000])
def test_components(spark, monkeypatch, few):
    """By rounds alone, rounds with a remainder, and at once."""
    monkeypatch.setattr(common, "FEW_EDGES", few)
    pairs = graph(few)
    rows = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == expected(pairs)


def test_few_edges_take_few_jobs(spark):
    """The driver keeps what it knows of each job, so a small graph must not take rounds of them."""
    pairs = graph(7)
    found, jobs = jobs_of(spark, "few edges", lambda: common.components(spark.createDataFrame(pairs, "a long, b long")))
    assert {r["node"]: r["root"] for r in found.collect()} == expected(pairs)
    assert jobs <= 15


def test_merged_components(spark):
    """Components known, and more links, give what all links give together."""
    first, more = graph(1, edges=150), graph(2, nodes=400, edges=60)
    node = lambda x: F.struct(F.col(x).alias("h1"), (-F.col(x)).alias("h2"))
    links = [spark.createDataFrame(p, "a long, b long").select(node("a").alias("na"), node("b").alias("nb")) for p in (first, more)]
    found = lines._merged(common.components(links[0], "na", "nb"), links[1]).collect()
    assert len(found) == len({r["node"] for r in found})
    got = {r["node"]["h1"]: r["root"]["h1"] for r in found}
    want = expected(first + more)
    assert got == {x: want[x] for x in got} and {x for x, r in want.items() if r != x} <= set(got)

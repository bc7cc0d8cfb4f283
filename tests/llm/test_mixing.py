import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, hard_texts
from touchline.llm import mixing, queries


def test_targets_shares_and_limits(spark):
    rows = queries.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        text, source = docs[r["doc_id"]]["text"], docs[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = mixing.water_fill([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], sum(sizes.values()), 3)
    for name, t in zip(names, wanted, strict=True):
        assert target[name] == pytest.approx(t)
        assert taken[name] == pytest.approx(t, rel=0.01, abs=50)
    again = queries.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_water_fill_reshares_the_excess():
    assert mixing.water_fill([10, 100, 100], [3, 1, 2], 210, 3) == pytest.approx([30, 60, 120])
    assert mixing.water_fill([1, 1], [1, 1], 2, 3) == [1, 1]


def test_flow_prefers_fresh_words_over_repeats():
    patterns = [("ab", ["a", "b"], 100), ("b", ["b"], 100)]
    plan = mixing.route(patterns, {"a": 1, "b": 1}, 3)
    assert plan.passes == {"ab": 1, "b": 1} and plan.rest == {"ab": 0, "b": 0}
    given = mixing.route([("a", ["a"], 10), ("b", ["b"], 190)], {"a": 1, "b": 9}, 3)
    assert (given.passes["a"], given.rest["a"]) == (2, 0)


def test_overlapping_sources_and_no_source(spark):
    docs = documents(spark, ["a b c d"] * 30 + ["e f"] * 5)
    member = F.when(F.col("text") == "e f", F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("y")))
    mixed, plan = mixing.mix(docs, memberships=member)
    assert mixed.columns == docs.columns  # a column mix is replaced in its place
    rows = mixed.select("text", "mix.taken").collect()
    assert sum(r["taken"] for r in rows) == 120 and all(r["taken"] == 0 for r in rows if r["text"] == "e f")


def test_hard_rows(spark):
    texts = hard_texts()
    docs = documents(spark, texts, sources=[None, "b", *["a"] * (len(texts) - 2)], ids=[None, *range(1, len(texts))])
    mixed, _ = mixing.mix(docs)
    assert mixed.count() == len(texts)
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns and all(r["text"] and r["text"].split() for r in kept.collect())
    empty, _ = mixing.mix(docs.limit(0))
    assert empty.count() == 0


def test_filling_goes_on_until_nothing_fits(spark):
    sizes = [900] + [1 + i % 7 for i in range(200)]
    docs = spark.createDataFrame([(i, "w " * n, s) for s in ("a", "b") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in range(2):
        mixed, plan = mixing.mix(docs, weights={"a": 1, "b": 2}, seed=seed)
        rows = mixed.select("source", "mix.size", "mix.taken").collect()
        for name, _, target in plan.sources:
            own = [r for r in rows if r["source"] == name]
            gap = round(target) - sum(r["taken"] for r in own)
            assert 0 <= gap < min(r["size"] for r in own)


def test_copies_are_counted_one_by_one(spark):
    """A source of 50 equal rows reaches its target, and so does one with copies among other documents."""
    rows = [(1, "w " * 10, "a")] * 50 + [(2 + i, "w " * (5 + i % 4), "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, plan = mixing.mix(docs, weights={"a": 4, "b": 8})
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("mix.taken").alias("n")).collect()}
    for name, _, target in plan.sources:
        assert -1 < target - taken[name] < 10
    docs = spark.createDataFrame([(1, "w " * 6, "a")] * 3 + [(2, "w " * 5, "a"), (3, "w " * 20, "b")], "doc_id long, text string, source string")
    mixed, plan = mixing.mix(docs, weights={"a": 1, "b": 3})
    assert sum(r["taken"] for r in mixed.where("source = 'a'").select("mix.taken").collect()) in (10, 11)  # 11 words are wanted of a


def test_route_costs_as_little_as_any_flow():
    """Against all ways to split the words of three patterns between two sources."""
    import itertools

    for words in ((3, 2, 4), (1, 5, 2), (4, 1, 1)):
        patterns = [("a", ["a"], words[0]), ("ab", ["a", "b"], words[1]), ("b", ["b"], words[2])]
        plan = mixing.route(patterns, {"a": 1, "b": 2}, 2)
        wanted = {name: round(t) for name, _, t in plan.sources}

        def cost(n, w):
            return sum(k // w for k in range(n))  # the n-th word's pass

        given = [plan.passes[k] * w + plan.rest[k] for k, _, w in patterns]
        best = None
        for x, y, z in itertools.product(range(2 * words[0] + 1), range(2 * words[1] + 1), range(2 * words[2] + 1)):
            for to_a in range(y + 1):
                if x + to_a <= wanted["a"] and y - to_a + z <= wanted["b"]:
                    price = -(x + y + z), cost(x, words[0]) + cost(y, words[1]) + cost(z, words[2])
                    best = min(best or price, price)
        assert (-sum(given), sum(cost(n, w) for n, w in zip(given, words, strict=True))) == best

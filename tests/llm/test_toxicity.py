import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, hard_texts
from touchline.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return queries.op4_toxicity(spark, SF).collect(), labels


def test_folds_and_ranges(scored, spark):
    rows, _ = scored
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_held_out_toxic_documents_are_found(scored):
    rows, labels = scored
    own = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    bad, good = [s for s, t in own if t == 1], [s for s, t in own if t == 0]
    better = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    print(len(bad), len(good), better, sum(b >= 0.7 for b in bad) / len(bad), sum(g >= 0.7 for g in good) / len(good))
    assert better > 0.95
    assert sum(b >= 0.7 for b in bad) > 0.8 * len(bad) and sum(g >= 0.7 for g in good) < 0.05 * len(good)


def test_hard_rows_and_no_labels(spark):
    texts = hard_texts()
    docs = documents(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model, [F.col("doc_id"), F.col("lines")])
    assert found.count() == len(texts) and toxicity.score(docs.limit(0), model).count() == 0


def test_rare_words_and_all_ordinary_rows_count(spark):
    name = "abcdefghijklmnopqrstuvwxyz"
    own = [f"own{name[i // 26]}{name[i % 26]}" for i in range(220)]  # one word of its own in each text
    docs = documents(spark, [f"some words before {w} and some after" for w in own])
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(220)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity._look(model["word"], model["uni"], toxicity.word_hashes(own), 0.0)
    assert (found[:20] > 0).sum() > 10 and (found[20:] < 0).sum() > 130


def test_context_of_one_class_is_no_evidence():
    first, second = np.array([1, 3, 3], np.uint64), np.array([3, 5, 7], np.uint64)
    model = toxicity.fit_model(first, second, np.array([1, 1, 0], np.int32), np.array([0, 2, 9], np.int32))
    at = np.searchsorted(model["pair"], toxicity.pair_hash(first[:1], second[:1]))[0]
    assert 0 < model["bi"][at] < 2


def test_bigrams_come_in_parts_and_whole(spark):
    counts = spark.range(1000).selectExpr("id as first", "-2 * id - 1 as second", "cast(id % 5 as int) as n1", "cast(id % 3 as int) as n0")
    found = toxicity._fetched(counts, rows_each=64)
    first = found[0].view("int64").tolist()
    assert sorted(first) == list(range(1000))
    assert [found[1].view("int64").tolist(), found[2].tolist(), found[3].tolist()] == [[-2 * i - 1 for i in first], [i % 5 for i in first], [i % 3 for i in first]]
    assert first != sorted(first)  # several parts

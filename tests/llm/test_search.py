import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm.helpers import documents, hard_texts
from touchline.llm import search


def brute(texts, asked, k=10, k1=1.2, b=0.75):
    words = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in texts.items()}
    n, mean = len(words), sum(c.total() for c in words.values()) / max(1, len(words))
    df = Counter(w for c in words.values() for w in c)
    out = {}
    for q in asked:
        scores = []
        for i, c in words.items():
            own = [w for w in words[q] if w in c]
            if own:
                norm = k1 * (1 - b + b * c.total() / mean)
                s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + norm) for w in own)
                scores.append((-s, i))
        out[q] = sorted(scores)[:k]
    return out


def same(rows, expected, k=10):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert set(found) == {q for q, x in expected.items() if x}
    for q, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert len(own) == len(expected[q])
        for (_, _, score), (wanted, _) in zip(own, expected[q], strict=True):
            assert abs(score + wanted) < 1e-5


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    asked = [i for i in texts if i % 50 == 0]
    same(search.search(docs, docs.where("doc_id % 50 = 0")).collect(), brute(texts, asked))


def test_shards_and_blocks_do_not_change_the_result(spark, monkeypatch):
    texts = dict(enumerate(hard_texts() + [f"word{i % 7} common rare{i}" for i in range(300)]))
    docs = documents(spark, list(texts.values()))
    build = search.build_index
    monkeypatch.setattr(search, "build_index", lambda *a, **k: build(*a, **(k | {"shard_docs": 70})))
    rows = search.search(docs.repartition(3), docs.where("doc_id % 5 = 0"), block_queries=20).collect()
    same(rows, brute(texts, [i for i in texts if i % 5 == 0]))


def test_empty_tables_and_null_ids(spark):
    docs = documents(spark, ["a b", "a", None], ids=[1, None, 2])
    assert [tuple(r)[:3] for r in search.search(docs, docs).collect()] == [(1, 1, 1)]
    assert search.search(docs.limit(0), docs).count() == 0 and search.search(docs, docs.limit(0)).count() == 0


def test_thousands_of_queries_take_one_pass_over_the_index(spark, monkeypatch):
    docs = documents(spark, [f"word{i % 7} rare{i % 50} own{i}" for i in range(1500)])
    names, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, name, *a, **k: names.append(name) or cut(df, name, *a, **k))
    assert search.search(docs, docs).where("rank = 1 and query_id = doc_id").count() == 1500
    assert names.count("hits") == 1


def test_blocks_of_queries_are_bounded_in_words(spark, monkeypatch):
    texts = dict(enumerate([" ".join(f"w{(i * 7 + j) % 90}" for j in range(40)) for i in range(60)]))
    names, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, name, *a, **k: names.append(name) or cut(df, name, *a, **k))
    docs = documents(spark, list(texts.values()))
    same(search.search(docs, docs, block_terms=500).collect(), brute(texts, texts))
    assert names.count("hits") > 2


def two_tongues(n):
    rng = random.Random(5)
    tongues = [[f"{c}{j}" for j in range(60)] for c in "ab"]
    return [" ".join(rng.choice(tongues[i % 2]) for _ in range(rng.randint(20, 60))) for i in range(n)]


def test_documents_of_like_words_share_a_shard(spark):
    texts = two_tongues(400)
    shards = search.build_index(documents(spark, texts), shard_docs=50).select("ids", "n").collect()
    mixed = sum(min(k, 1 - k) * r["n"] for r in shards for k in [(np.frombuffer(r["ids"], "<i8") % 2).mean()])
    assert sum(r["n"] for r in shards) == 400 and mixed < 20


def test_groups_tiles_and_single_precision_do_not_change_the_result(spark, monkeypatch):
    texts = dict(enumerate(two_tongues(600) + ["a1 a2 a3 b1"] * 90 + ["a1 b2"] * 3 + hard_texts()))
    build = search.build_index
    monkeypatch.setattr(search, "build_index", lambda *a, **k: build(*a, **(k | {"shard_docs": 300})))
    docs = documents(spark, list(texts.values()))
    rows = search.search(docs, docs.where("doc_id % 3 = 0"), k=4).collect()
    expected = brute(texts, [i for i in texts if i % 3 == 0], k=4)
    same(rows, expected)
    first = {r["query_id"]: r["doc_id"] for r in rows if r["rank"] == 1}
    for q in range(600, 690, 3):  # of equal documents the smallest ids come first
        assert first[q] == 600
        assert sorted(r["doc_id"] for r in rows if r["query_id"] == q) == [600, 601, 602, 603]


def test_a_block_serves_shards_as_a_plain_sum(monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 40)
    monkeypatch.setattr(search, "TILE", 7)
    monkeypatch.setattr(search, "BLOCK", 8)
    rng = np.random.default_rng(2)
    count = rng.poisson(np.geomspace(3, 0.02, 80), (500, 80))
    weights, k = rng.random(80) * 9, 5
    wanted = rng.random((30, 80)) < np.geomspace(0.9, 0.2, 80)
    parts = {"ids": np.arange(30), "ends": np.r_[0, wanted.sum(axis=1).cumsum()], "codes": np.nonzero(wanted)[1], "terms": np.arange(80), "weights": weights}
    packed = {p: parts[p].astype(kind).tobytes() for p, kind in zip(search.QUERY_PARTS, search.QUERY_KINDS, strict=True)}
    block, lengths = search.QueryBlock(packed, k), count.sum(axis=1)
    for some in np.array_split(np.arange(500), [220, 221, 225]):
        term, doc = np.nonzero(count[some].T)
        offsets = np.searchsorted(term, np.arange(81))
        own = dict(terms=np.arange(80, dtype=np.uint64), offsets=offsets, places=doc, counts=count[some].T[term, doc], lengths=lengths[some], ids=some)
        search.search_shard(block, own, lengths.mean(), 1.2, 0.75)
    norm = 1.2 * (0.25 + 0.75 * lengths / lengths.mean())[:, None]
    scores = np.round(wanted @ (weights * count * 2.2 / (count + norm)).T, 6)
    for q in range(30):
        order = np.lexsort((np.arange(500), -scores[q]))[:k]
        assert np.allclose(block.best[q], scores[q][order], atol=2e-6) and (block.best_ids[q] == order).all()


def test_words_are_those_of_the_pattern():
    every = [chr(c) for c in [*range(0x180), 0x2019, 0x3B1, 0x130, 0x1F600]]
    for text in [None, "", "a_b c", *every, *(f"x{c}Y{c} z" for c in every), "".join(every)]:
        assert search._words(text) == search.WORDS.findall((text or "").lower())

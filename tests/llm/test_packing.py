import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import documents, hard_texts
from touchline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity=4096):
    """Round trip of every document, and sequences without gaps; the number of sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_doc) == len(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and r["length"] == min(capacity, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_round_trip_of_hard_texts(spark):
    texts = [*hard_texts(), "<|endoftext|> and text", "don't we'll \x1c x", "İstanbul ǅ ﬁ", "漢字 かな", "x" * 5000, "it's-a/b\\c 3.14!?"]
    rows = packing.pack_documents(documents(spark, texts), PATH).collect()
    check(rows, dict(enumerate(texts)))


def encoder():
    with open(PATH, encoding="utf-8") as file:
        return packing.WordEncoder(file.read())


def test_every_letter_before_punctuation():
    """Letters that turn into a letter and a mark, as U+0958 and U+0130, join the punctuation after them."""
    texts = [chr(c) + "." for c in range(0x30000) if chr(c).isalpha()]
    texts += ["KİTAP, \u0958!? <|ENDOFTEXT|> <|endoftext|>. ÀÉß\u212a\u212b\u0178\u1e9e; x\x1cy z\u3000Z:", "", " \n"]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder().encode(pa.array(texts)) == want


def test_frequent_words_are_learnt_once(monkeypatch):
    """In capitals, with punctuation and after the cache was full, too; the caches stay bounded."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    some, learnt = encoder(), []
    learn = some.learn
    monkeypatch.setattr(some, "learn", lambda words: learnt.extend(words) or learn(words))
    letters = "abcdefghij"
    for a in letters:
        for b in letters:
            rare = [f"{a}{b}{c}" for c in letters]
            some.encode(pa.array([f"often Often OFTEN! (often) often,.. {' '.join(rare)} {'y' * 300}"]))
            assert len(some.cache) <= 50 + 20 and len(some.older) <= 50 + 20
            assert max(map(len, some.cache)) <= packing.LONG_WORD
    assert learnt.count("often") == 1 and "Often" not in learnt and "OFTEN" not in learnt
    assert len(learnt) == len(set(learnt)) + 99  # the long word is not kept


def test_portions():
    texts = pa.array(["", "ab", "x" * packing.TOGETHER, "", "c", "y" * packing.TOGETHER, "z"])
    found = list(packing._portions(texts))
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == len(texts)
    assert all(b - a == 1 or sum(len(x.as_py()) for x in texts[a:b]) <= packing.TOGETHER for a, b in found)
    assert list(packing._portions(texts.slice(5))) == [(0, 1), (1, 2)] and not list(packing._portions(texts.slice(7)))


def test_close_to_the_fewest_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sequences, tokens = check(packing.pack_documents(docs, PATH).collect(), texts)
    print(sequences, tokens / 4096)
    assert sequences <= 1.02 * tokens / 4096 + 2


def test_repeated_rows_nulls_and_empty_table(spark):
    docs = documents(spark, ["a b", "a b", None], ids=[1, 1, None])
    rows = packing.pack_documents(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 5)), rng.random(8) * 3 - 1
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-7).all() and abs(gain[x > 0]).max(initial=0) < 1e-7

import random

import numpy as np
import xxhash

from tests.llm.helpers import documents, hard_texts, union_find
from touchline.llm import simhash


def plain_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_definition():
    for text in [*hard_texts(), "A b C d É", "one two three four\x0bfive", "x y z"]:
        assert simhash.fingerprint(text) == plain_print(text), text


def brute(prints):
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    return union_find(range(len(prints)), pairs)


def test_links_match_brute_force(spark):
    rng = random.Random(7)
    prints = []
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.append(at)
            for _ in range(rng.choice([1, 2, 3])):
                at ^= 1 << rng.randrange(64)
    low = rng.getrandbits(22)
    prints += [low | rng.getrandbits(42) << 22 for _ in range(150)]  # one crowded segment
    prints += [prints[-k] ^ 1 << rng.randrange(22, 64) for k in range(1, 30)]
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for crowd in (2, 64):
        links = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash.near_links(nodes, crowd).collect()]
        assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in links) or crowd == 2
        assert union_find(range(len(prints)), links) == brute(prints)


def test_documents_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [*hard_texts(), "   ", None]
    for _ in range(20):
        own = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(own))
        texts += [" ".join([*own[:k], "changed", *own[k + 1 :]]) for k in rng.sample(range(len(own)), min(3, len(own)))]
    found = {r["doc_id"]: r for r in simhash.simhash_components(documents(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    root = brute(prints)
    assert [found[i]["component_id"] for i in range(len(texts))] == [root[i] for i in range(len(texts))]
    kept = simhash.keep_one(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    assert kept.columns == documents(spark, texts).columns


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b c", "a b c", "q w e r t y", "a b c"], ids=[None, 5, None, 5])
    rows = sorted(((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()), key=str)
    assert rows == [(False, 5, 5), (False, 5, 5), (True, None, 5), (True, None, None)]
    assert simhash.keep_one(docs).count() == 2
    assert simhash.simhash_components(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0

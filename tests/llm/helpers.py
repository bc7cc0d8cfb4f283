"""Rows for the tests of the subpackage: hard cases in one small table."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines string, mix string, fp string, id string, hash string, rank string"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """texts as documents, with further columns whose names operators use themselves."""
    rows = []
    for i, text in enumerate(texts):
        lang = langs[i] if langs else "en"
        source = sources[i] if sources else "web"
        rows.append((ids[i] if ids else i, text, lang, source, len(text or ""), "a", "b", "c", "d", "e", "f"))
    return spark.createDataFrame(rows, SCHEMA)


def hard_texts():
    """Null, empty, blank, very long and repeated texts, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    some = " ".join(rng.choice(words) for _ in range(80))
    return [None, "", " \n\t ", long, some, some, some + " more", "!!! 123 ...", "😀 naïve Straße x", "a", "a b"]


def union_find(nodes, pairs):
    """The smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}

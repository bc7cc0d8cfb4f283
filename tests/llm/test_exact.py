import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, hard_texts
from touchline.llm import exact


def brute_force(rows):
    """Rows (id, text) as (id, keep_id, group_size, kept, sha256), counted."""
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups["".join(c for c in text or "" if c not in exact.WHITE)].append((i, text or ""))
    out = []
    for norm, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        left = True
        for i, text in own:
            kept = left and (i, len(text)) == (best[0], len(best[1]))
            left &= not kept
            out.append((i, best[0], len(own), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return collections.Counter(out)


def found(docs, **options):
    return collections.Counter(map(tuple, exact.find_copies(docs, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"capacity": 2, "page_rows": 2}, {"page_rows": 8, "key": lambda norm: F.length(norm) % 5}])
def test_against_brute_force(spark, options):
    """Ordinary keys, tiny buckets and pages, and keys that nearly all texts share."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000 + i, "a  b\tc" + " " * (i % 7)) for i in range(300)] + [(None, "abc")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, **options) == brute_force(rows)


def test_hard_rows(spark):
    texts = hard_texts()
    ids = [None, *range(1, len(texts) - 1), 5]
    docs = documents(spark, texts, ids=ids)
    assert found(docs, capacity=1, page_rows=1) == brute_force(list(zip(ids, texts, strict=True)))
    assert exact.find_copies(docs.limit(0)).count() == 0
    kept = exact.keep_unique(docs)
    assert kept.columns == docs.columns and kept.count() == len({"".join((t or "").split()) for t in texts})


def test_repeated_rows_leave_one(spark):
    docs = documents(spark, ["x y"] * 9, ids=[3] * 9)
    assert sum(r["kept"] for r in exact.find_copies(docs, page_rows=2).collect()) == 1


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h")).union(spark.range(50).select(F.col("id").alias("h")))
    buckets = exact.grow_directory(keys, 40)
    rows = buckets.collect()
    assert max(r["n"] for r in rows) <= 40 and sum(r["n"] for r in rows) == 3050
    assert len({r["depth"] for r in rows}) > 1  # 50 neighbouring keys split further than the others
    placed = exact.look_up(keys, buckets)
    assert placed.count() == 3050
    owned = placed.groupBy("place").count().collect()
    assert len(owned) == len(rows)

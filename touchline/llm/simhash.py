"""SimHash near-duplicates: 64-bit fingerprints linked by Hamming distance.

Fingerprints are taken in Arrow batches. Equal fingerprints are one node from then on.
Candidates come from the pigeonring principle: with m segments on a ring and at most t
differing bits, some segment starts a chain of which every prefix of l segments differs
in at most floor(l * t / m) bits. For t = 2 and m = 3 that start segment is equal (the
key of an equi-join), the next one differs in one bit at most, and the whole in two.

A segment value that more than ``crowd`` fingerprints share would make a quadratic join.
Its members are linked exactly by another way: two fingerprints differ in two bits at
most if, and only if, some word lies within one bit of both. Every member names the 65
words within one bit of itself, and a word has 65 such members at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, cut, discard

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text: XXH64 of word shingles, repeats included; no words: 0."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 15):
        ones += bits[at : at + (1 << 15)].sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id_col, fp (the 64 bits as a signed long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [id_col, "fp"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


def near_links(nodes: DataFrame, crowd: int = 64) -> DataFrame:
    """a, b: pairs that connect every two fingerprints of at most two differing bits.

    nodes has distinct longs in fp. Every such pair is joined by a path of links; pairs
    in crowded segments are not all listed.
    """
    widths = ((0, 22), (22, 21), (43, 21))
    part = [f"(shiftrightunsigned(fp, {at}) & {(1 << n) - 1})" for at, n in widths]
    rows = ", ".join(f"named_struct('i', {i}, 'key', {part[i]}, 'next', {part[(i + 1) % 3]})" for i in range(3))
    segments = nodes.select("fp", F.expr(f"inline(array({rows}))"))
    crowded = cut(segments.groupBy("i", "key").count().where(F.col("count") > crowd).select("i", "key"), "crowded")

    few = segments.join(crowded, ["i", "key"], "left_anti")
    left, right = few.alias("x"), few.alias("y")
    chain = (
        (F.col("x.i") == F.col("y.i"))
        & (F.col("x.key") == F.col("y.key"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.expr("bit_count(x.next ^ y.next)") <= 1)
        & (F.expr("bit_count(x.fp ^ y.fp)") <= 2)
    )
    links = left.join(right, chain).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    many = segments.join(crowded, ["i", "key"], "left_semi").select("fp").distinct()
    near = many.select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))")).alias("word")
    )
    met = near.groupBy("word").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.col("fps")[0].alias("a"), F.explode(F.expr("slice(fps, 2, size(fps) - 1)")).alias("b"))
    return links.union(stars)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = 64
) -> DataFrame:
    """id_col, fp, component_id (the smallest id reachable over links of two bits at most).

    Null and blank texts have fingerprint 0 and link like any other; a null id is kept and
    counts as the largest; repeated rows stay; an empty table gives no rows.
    """
    prints = cut(add_fingerprint(docs, id_col, text_col, width), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    found = components(near_links(nodes.select("fp"), crowd))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = cut(rooted, "rooted")
    lowest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    discard(nodes, found, rooted, lowest)
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component: the smallest id's (of equal ids, one text by hash).

    A null id counts as the largest and is kept where its component has no other. Rows equal
    in id and text are one row. All columns of docs pass through.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    keyed = keyed.select(F.struct("id", "hash").alias("row"), "text")
    groups = cut(simhash_components(keyed, "row", "text"), "groups")
    ids = cut(groups.select("component_id").distinct(), "kept")
    kept = ids.select(F.col("component_id.id").alias("__kept_id"), F.col("component_id.hash").alias("__kept_hash"))
    same = docs[id_col].eqNullSafe(F.col("__kept_id")) & (F.xxhash64(docs[text_col]) == F.col("__kept_hash"))
    found = docs.withColumn("__hash", F.xxhash64(text_col)).join(kept, same, "left_semi")
    return found.dropDuplicates([id_col, "__hash"]).drop("__hash")

"""Exact dedup through an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash of what is left without white space. The directory points
from the first bits of a key to a bucket; while a bucket holds more keys than it may, the
directory doubles (one more bit) and the overfull buckets split. A key with many copies
cannot split; it becomes a chain of pages, each of so many rows and bytes at most.

Owner tasks take ranges of (bucket, key, page). Within a page, rows of a key are chained:
every row is compared byte by byte with the texts of the chain, so keys that collide keep
apart. Pages of one key meet again, fewer each time, by the first row of each of their
texts, until one page is left. Keys that occur once need no bytes at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, discard

WHITE = " \t\n\x0b\f\r"
CAPACITY = 4096  # keys of a bucket at most
PAGE_ROWS = 128
PAGE_BYTES = 16 << 20
FAN = 64  # pages of a key that meet in one page of the next level


def normalised(text: Column) -> Column:
    """text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def _bucket(depth: Column | int) -> Column:
    """The first ``depth`` bits of key h, as a number from 0."""
    shift = F.lit(64) - depth if isinstance(depth, Column) else F.lit(64 - depth)
    return F.when(shift < 64, F.call_function("shiftrightunsigned", F.col("h"), shift.cast("int"))).otherwise(F.lit(0))


def grow_directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Buckets as (bucket, depth, n): the first ``depth`` bits of the keys in it, and how many it holds.

    keys: distinct h, from a written table. The directory begins at the depth at which evenly
    spread keys just fit and doubles until no bucket is overfull; only keys of overfull buckets are
    counted again. Distinct keys differ in some bit, so that the doubling ends at 64 bits at most.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count() / capacity))))
    overfull, levels = None, []
    while True:
        found = keys.select("h", _bucket(depth).alias("bucket"))
        if overfull is not None:
            above = overfull.select(F.col("bucket").alias("above"))
            found = found.join(above, F.expr("shiftright(bucket, 1)") == F.col("above"), "left_semi")
        counted = cut(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "directory", free=False)
        levels.append(counted.where(F.col("n") <= capacity).select("bucket", F.lit(depth).alias("depth"), "n"))
        overfull = counted.where(F.col("n") > capacity)
        if overfull.isEmpty():
            break
        depth += 1
    buckets = levels[0]
    for level in levels[1:]:
        buckets = buckets.unionByName(level)
    return buckets


def look_up(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """keys with ``place``, where the bucket of h begins among all keys (63 bits, in order)."""
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # 64 at most
    asked = keys.withColumn("depth", F.explode(F.array(*map(F.lit, sorted(depths))))).withColumn("bucket", _bucket(F.col("depth")))
    place = F.expr("shiftrightunsigned(shiftleft(bucket, 64 - depth), 1)")
    found = asked.join(buckets.select("bucket", "depth"), ["bucket", "depth"])
    return found.select(*keys.columns, place.alias("place"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, page and worth, with their link of the chain; link_first: the first row of its text, which keeps its bytes."""
    at, chain = None, {}
    for batch in batches:
        names = batch.schema.names
        column = {n: batch.column(n) for n in names}
        texts = column["norm"]
        links, firsts = [], []
        for i, where in enumerate(zip(column["h"].to_pylist(), column["page"].to_pylist(), strict=True)):
            if where != at:
                at, chain = where, {}
            text, links_so_far = texts[i].as_py(), len(chain)
            link = chain.setdefault(text, links_so_far)  # equal hash, then equal bytes
            links.append(link)
            firsts.append(link == links_so_far)
        firsts = pa.array(firsts)
        column["norm"] = pa.compute.if_else(pa.compute.and_(firsts, pa.compute.greater(column["pages"], 1)), texts, pa.scalar(None, texts.type))
        yield pa.RecordBatch.from_arrays([*column.values(), pa.array(links, pa.int32()), firsts], [*names, "link", "link_first"])


def _own(rows: DataFrame, owners: int, name: str) -> DataFrame:
    """rows through their owner tasks, each a range of (place, h, page), written to the shared folder."""
    ranged = rows.repartitionByRange(owners, "place", "h", "page").sortWithinPartitions("place", "h", "page", F.col("n").desc(), F.col("id").asc_nulls_last())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return cut(ranged.mapInArrow(_follow, f"{schema}, link int, link_first boolean"), name)


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Column | None = None,
    capacity: int = CAPACITY,
    page_rows: int = PAGE_ROWS,
    key=key_of,
) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of docs, and carry where one is given.

    Texts are equal when they are after deleting ASCII white space; the row with the most code
    points of its whole text stays, then the smallest id (null last). Of rows equal in id, text
    and length just one stays. A null text is an empty one; texts of any length are compared
    whole; an empty table gives no rows. Only id_col, text_col and carry are read, so that other
    columns may have any name. carry: a column (a struct of all columns, say) handed through.
    """
    norm = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n"),
        norm.alias("norm"),
        (F.lit(None).cast("string") if carry is None else carry).alias("carry"),
        F.monotonically_increasing_id().alias("roll"),
    ).withColumn("h", key(F.col("norm")))

    size = F.sum(F.octet_length("norm").cast("long"))
    keys = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes")), "keys")
    buckets = grow_directory(keys, capacity)
    pages = F.greatest(F.ceil(F.col("rows") / page_rows), F.ceil(F.col("bytes") / PAGE_BYTES)).cast("long")
    shared = cut(look_up(keys.where("rows > 1").select("h", pages.alias("pages")), buckets), "index")

    held = rows.join(shared, "h", "left")
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    page = F.coalesce(F.pmod("roll", "pages"), F.lit(0))
    bytes_ = F.when(F.col("pages").isNotNull(), F.col("norm").cast("binary"))
    routed = held.select("h", "id", "n", "carry", "place", "pages", page.alias("page"), sha.alias("sha"), bytes_.alias("norm"))
    routed = cut(routed, "routed")

    load = keys.where("rows > 1").agg(F.sum("rows"), F.sum("bytes")).first()
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (load[0] or 0) >> 16, (load[1] or 0) >> 26)
    members = _own(routed.where("pages is not null"), owners, "members")

    spot = ["h", "page", "link"]
    heads = members.where("link_first")
    top = heads.select("h", "page", "link", F.col("page").alias("at"), F.col("link").alias("head"), F.lit(True).alias("first"))
    level = heads.where("pages > 1").select("place", "h", "page", "pages", "id", "n", "norm", F.col("page").alias("was"), F.col("link").alias("was_link"))
    written = []
    while not level.isEmpty():
        fewer = level.withColumns({"page": F.floor(F.col("page") / FAN).cast("long"), "pages": F.ceil(F.col("pages") / FAN).cast("long")})
        met = _own(fewer, owners, "heads")
        up = met.select("h", F.col("was").alias("at"), F.col("was_link").alias("head"), F.col("page").alias("to"), F.col("link").alias("to_link"), "link_first")
        risen = top.join(up, ["h", "at", "head"], "left")
        top = cut(
            risen.select(
                *spot,
                F.coalesce("to", "at").alias("at"),
                F.coalesce("to_link", "head").alias("head"),
                (F.col("first") & F.coalesce("link_first", F.lit(True))).alias("first"),
            ),
            "top",
            free=False,
        )
        level = met.where("link_first and pages > 1").select(*level.columns[:7], F.col("page").alias("was"), F.col("link").alias("was_link"))
        written.append(met)

    counted = members.groupBy(*spot).agg(F.count(F.lit(1)).alias("rows")).join(top, spot)
    best = heads.select(*spot, "id").join(top.where("first").select(*spot, "at", "head"), spot)
    groups = counted.groupBy("h", "at", "head").agg(F.sum("rows").alias("group_size"))
    groups = groups.join(best.select("h", "at", "head", F.col("id").alias("keep_id")), ["h", "at", "head"])
    said = cut(top.join(groups, ["h", "at", "head"]).select(*spot, "first", "group_size", "keep_id"), "groups")
    kept = (F.col("link_first") & F.col("first")).alias("kept")
    copies = members.select(*spot, "id", "sha", "carry", "link_first").join(said, spot)  # a page bounds the rows of a spot
    out = [F.col("group_size"), kept, F.col("sha").alias("text_sha256"), F.col("carry")]
    copies = copies.select(F.col("id").alias(id_col), "keep_id", *out)
    alone = routed.where("pages is null").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "carry"
    )
    discard(keys, *written)
    found = copies.unionByName(alone)
    return found if carry is not None else found.drop("carry")


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = find_copies(docs, id_col, text_col, F.struct(*(f"`{c}`" for c in docs.columns)), **options)
    return found.where("kept").select("carry.*")

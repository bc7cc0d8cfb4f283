"""Line deduplication: one line is kept of each group of equal or nearly equal lines.

Lines are trimmed of ASCII white space; shorter ones than min_chars are left alone.
Equal lines are found by two 64-bit hashes. For nearly equal lines, MinHash over character
shingles gives signatures, bands of signature rows give candidates, and the exact Jaccard
similarity of the shingle sets decides. Links are closed by distributed union-find.

A bucket of a band is never expanded into all its pairs. Its members are compared with
the smallest one, and components are formed. Members that are then still apart from it
are compared with all members of the bucket: one by one where the bucket is of FEW_LINES
lines at most, so that a pair of several buckets is compared once, and else in blocks. Of
all blocks that a task compares only a spanning forest comes out: a link whose ends are
connected by earlier links says nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, cut, discard

SECOND_SEED = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)  # so that Spark's xxhash64(1, line) is the same
BLANK = " \t\r\x0b\x0c"
CHUNK = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
BLOCK_LINES = 256
FEW_LINES = 16
COLUMNS = 1 << 14  # shingles counted at once in a block


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolled(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes over all lines, joined, and where each line's own hashes start and end.

    A hash of n characters is made of two of n / 2, so a shingle takes few passes.
    """
    units = np.frombuffer("\n".join(lines).encode("utf-16-le", "surrogatepass"), np.uint16)
    ends = np.append(np.nonzero(units == 10)[0], len(units))  # a line holds no line break
    single = units.astype(np.uint64)
    rolled, width = single, 1
    for bit in bin(shingle)[3:]:
        size = len(rolled) - width
        rolled = rolled[:size] * np.uint64(pow(FACTOR, width, 1 << 64)) + rolled[width : width + size]
        width *= 2
        if bit == "1":
            size = len(units) - width
            rolled = rolled[:size] * np.uint64(FACTOR) + single[width : width + size]
            width += 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return _mix(rolled), starts, ends - shingle + 1


def _groups(lines: list[str], size: int = 1 << 16) -> Iterator[list[str]]:
    """The lines in order, in groups of about size characters, whose arrays stay in a processor's cache."""
    at, held = 0, 0
    for i, line in enumerate(lines):
        held += len(line) + 1
        if held >= size:
            yield lines[at : i + 1]
            at, held = i + 1, 0
    if at < len(lines):
        yield lines[at:]


def band_keys(lines: list[str], shingle: int, bands: int, rows: int) -> np.ndarray:
    """For each line (of shingle characters at least) a key for each band of its MinHash signature."""
    return np.concatenate([_band_keys(own, shingle, bands, rows) for own in _groups(lines)])


def _band_keys(lines: list[str], shingle: int, bands: int, rows: int) -> np.ndarray:
    rolled, starts, ends = _rolled(lines, shingle)
    across = (ends[:-1, None] + np.arange(shingle)).ravel()  # shingles of two lines
    base = np.delete((rolled >> np.uint64(32)).astype(np.uint32), across)
    edges = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    odd = np.random.default_rng(2).integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    signature = np.empty((bands * rows, len(lines)), np.uint64)
    scratch = np.empty_like(base)
    for k in range(bands * rows):
        np.multiply(base, odd[k], out=scratch)
        signature[k] = np.minimum.reduceat(scratch, edges)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[r::rows])
    return keys.T


def shingle_sets(lines: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each line's shingles."""
    rolled, starts, ends = _rolled(lines, shingle)
    found = []
    for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
        own = np.sort(rolled[low:high])
        new = np.empty(len(own), bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        found.append(own[new])
    return found


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def similar(sets: list[np.ndarray], first: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of one of the first sets and one of the others with the similarity.

    Shared shingles are counted by matrix products over COLUMNS shingles at a time, which bounds the memory.
    """
    sizes = np.array([len(x) for x in sets])
    distinct, code, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held_by[code] > 1  # a shingle of one line only is in no intersection
    rank = np.cumsum(held_by > 1) - 1
    owner, code = np.repeat(np.arange(len(sets)), sizes)[shared], rank[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((first, len(sets) - first), np.float32)
    width = int(code[-1]) + 1 if len(code) else 0
    for low in range(0, width, COLUMNS):
        some = slice(*np.searchsorted(code, [low, low + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, width - low)), np.float32)
        held[owner[some], code[some] - low] = 1
        both += held[:first] @ held[first:].T
    whole = sizes[:first, None] + sizes[None, first:] - both
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(both >= threshold * whole - 1e-6), strict=True)]


def _occurrences(docs: DataFrame, columns: list[Column], text_col: str, min_chars: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """columns, pos, h1, h2 of every line that takes part, and keys where a line comes first in its batch."""
    picked = docs.select(*columns, F.col(text_col).alias("__text"))
    at = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, int] = {}
            owner, pos, which, size = [], [], [], 0
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows:
                    for k, raw in enumerate((batch.column(at)[i].as_py() or "").split("\n")):
                        line = raw.strip(BLANK)
                        if len(line) >= min_chars:
                            n = held.setdefault(line, len(held))
                            size += len(line) if n == len(held) - 1 else 0
                            owner.append(i)
                            pos.append(k)
                            which.append(n)
                if held and (size >= CHUNK or i == batch.num_rows):
                    lines = list(held)
                    raw_lines = [x.encode() for x in lines]
                    h1 = np.array([xxhash.xxh64_intdigest(x, 42) for x in raw_lines], np.uint64).view(np.int64)
                    h2 = np.array([xxhash.xxh64_intdigest(x, SECOND_SEED) for x in raw_lines], np.uint64).view(np.int64)
                    keys = band_keys(lines, shingle, bands, rows)
                    of = np.array(which)
                    first = np.zeros(len(of), bool)
                    first[np.unique(of, return_index=True)[1]] = True
                    offsets = np.concatenate([[0], np.cumsum(first * bands)]).astype(np.int32)
                    flat = pa.array(keys[of[first]].view(np.int64).ravel())
                    listed = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~first))
                    own = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:at]]
                    added = [pa.array(pos, pa.int32()), pa.array(h1[of]), pa.array(h2[of]), listed]
                    yield pa.RecordBatch.from_arrays([*own, *added], [*batch.schema.names[:at], "pos", "h1", "h2", "keys"])
                    held, owner, pos, which, size = {}, [], [], [], 0

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:at]]
    return picked.mapInArrow(run, ", ".join([*fields, "pos int, h1 long, h2 long, keys array<long>"]))


def _texts(docs: DataFrame, text_col: str, min_chars: int, wanted: DataFrame) -> DataFrame:
    """h1, h2, line of the lines whose h1 is in wanted."""
    split = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("raw"))
    # Trimming and counting characters walk over a whole line; most lines show by their ends and bytes that neither is needed.
    blank_end = " OR ".join(f"{at}(raw, '{c}')" for at in ("startswith", "endswith") for c in BLANK)
    trimmed = split.select(F.expr(f"CASE WHEN {blank_end} THEN trim(BOTH '{BLANK}' FROM raw) ELSE raw END").alias("line"))
    trimmed = trimmed.where((F.octet_length("line") >= 4 * min_chars) | (F.length("line") >= min_chars))
    hashed = trimmed.select("line", F.xxhash64("line").alias("h1"))
    # An inner join, as wanted is distinct: Spark moves a semi join below the bitmap, and then shuffles every line.
    some = _in_bitmap(hashed, "h1", wanted, "h1").join(wanted, "h1")
    return some.select("h1", F.xxhash64(F.lit(1), "line").alias("h2"), "line").dropDuplicates(["h1", "h2"])


def _in_bitmap(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose column may be among the keys of wanted, by a bitmap of 2^24 bits.

    The bitmap is a table of 2^18 words at most, whatever the input, so it is broadcast. It
    spares the shuffle of rows that cannot match; an exact join follows.
    """
    bit = F.pmod(F.col(key), F.lit(1 << 24))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("__bits"))
    met = rows.withColumn("__word", F.shiftright(F.pmod(F.col(column), F.lit(1 << 24)), 6)).join(F.broadcast(words), "__word")
    return met.where(F.expr(f"(shiftrightunsigned(__bits, cast(pmod({column}, 64) as int)) & 1) = 1")).drop("__word", "__bits")


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """a, b, na, nb (full nodes), linked, for pairs a, b of line ids."""
    left = texts.select(F.col("h1").alias("a"), F.struct("h1", "h2").alias("na"), F.col("line").alias("la"))
    right = texts.select(F.col("h1").alias("b"), F.struct("h1", "h2").alias("nb"), F.col("line").alias("lb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                first, second = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                place: dict[str, int] = {}
                for line in (*first, *second):
                    place.setdefault(line, len(place))
                sets = shingle_sets(list(place), shingle)
                near = [jaccard(sets[place[x]], sets[place[y]]) >= threshold for x, y in zip(first, second, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())], ["a", "b", "na", "nb", "linked"])

    node = "struct<h1:bigint,h2:bigint>"
    return joined.mapInArrow(run, f"a long, b long, na {node}, nb {node}, linked boolean")


def near_classes(
    docs: DataFrame,
    seen: DataFrame,
    text_col: str = "text",
    min_chars: int = 20,
    shingle: int = 7,
    threshold: float = 0.8,
) -> DataFrame:
    """node, root: lines (nodes of two hashes) linked by the threshold's similarity, and the smallest line reachable.

    seen is the written table of _occurrences(). Lines without a link are not listed.
    """
    placed = seen.where("keys is not null").select(F.explode("keys").alias("key"), F.col("h1").alias("id"))
    buckets = placed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    buckets = cut(buckets.where("lo < hi").drop("hi"), "buckets")
    members = _in_bitmap(placed, "key", buckets, "key").join(buckets, "key").where("id > lo").distinct()
    members = cut(members, "members")
    discard(buckets)
    wanted = cut(members.select(F.col("id").alias("h1")).union(members.select("lo")).distinct(), "wanted")
    texts = cut(_texts(docs, text_col, min_chars, wanted), "texts")
    discard(wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(_verify(pairs.distinct(), texts, shingle, threshold).where("linked").select("na", "nb"), "verified")

    links = verified(members.select(F.col("lo").alias("a"), F.col("id").alias("b")))
    found = components(links, "na", "nb")
    discard(links)
    roots = found.select(F.col("node.h1").alias("id"), F.col("root.h1").alias("root"))
    placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = cut(placed.join(roots.select(F.col("id").alias("lo"), F.col("root").alias("lo_root")), "lo", "left"), "placed")
    discard(members)
    apart = placed.where(F.col("root") != F.coalesce("lo_root", "lo"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(apart.select("key").distinct(), "key")
    sizes = cut(sizes, "sizes")
    few, many = sizes.where(F.col("n") <= FEW_LINES).select("key"), sizes.where(F.col("n") > FEW_LINES)
    one = apart.join(few, "key").select("key", "id", "root")
    other = placed.join(few, "key").select("key", F.col("id").alias("id2"), F.col("root").alias("root2"))
    pairs = one.join(other, "key").where("root <> root2").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    more = _block_links(apart, placed, many.select("key", F.ceil(F.col("n") / BLOCK_LINES).cast("long").alias("blocks")), texts, shingle, threshold)
    single, forest = verified(pairs), cut(more, "verified")
    discard(texts, placed, sizes)
    merged = _merged(found, single.union(forest))
    discard(found, single, forest)
    return merged


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of components() after more links na, nb, of which only those between two components are followed."""

    def top(node: str, root: str) -> DataFrame:
        return found.select(F.col("node").alias(node), F.col("root").alias(root))

    ends = links.join(top("na", "ra"), "na", "left").join(top("nb", "rb"), "nb", "left")
    ends = ends.select(F.coalesce("ra", "na").alias("a"), F.coalesce("rb", "nb").alias("b"))
    more = components(ends)
    up = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    nodes = found.select("node", "root").union(more.select("node", F.col("node").alias("root"))).distinct()
    merged = cut(nodes.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near")
    discard(more)
    return merged


def _block_links(apart: DataFrame, members: DataFrame, wanted: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """na, nb: links that connect the bucket members apart from their bucket's smallest line with all similar members of it.

    wanted: key and number of blocks of the buckets to look into.

    A bucket's members are dealt by hash into blocks of about BLOCK_LINES lines, and each
    block of members that are apart meets each block of the bucket, so a task holds two
    blocks at once. Tasks are dealt by bucket and block. A task joins what it has linked by
    union-find, from the components known before, and gives no more links than that has nodes.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        dealt = rows.select("key", "id", "root").join(wanted, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        full = dealt.join(texts.select(F.col("h1").alias("id"), "h2", "line"), "id")
        return full.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("id", "h2", "root", "line")).alias(name))

    mine = blocks(apart, "xs").select("key", "xs", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    met = mine.join(blocks(members, "ys").drop("blocks"), ["key", "block"]).select("xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = x = top.get(up, up)
            return x

        node = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                (ids, h2s, roots, texts_), (other_ids, other_h2s, other_roots, others) = (
                    [c[i].values.field(k).to_pylist() for k in range(4)] for c in batch.columns
                )
                for x, y in similar(shingle_sets(texts_ + others, shingle), len(ids), threshold):
                    one, two = find(roots[x]), find(other_roots[y])
                    if one != two:
                        top[max(one, two)] = min(one, two)
                        a.append({"h1": ids[x], "h2": h2s[x]})
                        b.append({"h1": other_ids[y], "h2": other_h2s[y]})
            yield pa.RecordBatch.from_arrays([pa.array(a, node), pa.array(b, node)], ["na", "nb"])

    node = "struct<h1:bigint,h2:bigint>"
    return met.mapInArrow(run, f"na {node}, nb {node}")


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, shingle: int = 7, bands: int = 11, rows: int = 4, **options
) -> DataFrame:
    """id, hash (of the text), drop: positions of the lines of a document that are kept elsewhere.

    Of each group of equal or linked lines, the one of the smallest id stays, then of the
    smallest text hash and position; a null id counts as the smallest. At a similarity of
    0.8, eleven bands of four rows miss one pair in three hundred.
    """
    min_chars = max(min_chars, shingle)
    columns = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")]
    seen = cut(_occurrences(docs, columns, text_col, min_chars, shingle, bands, rows), "occurrences")
    found = near_classes(docs, seen, text_col, min_chars, shingle, **options)
    roots = cut(
        found.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2")),
        "roots",
    )
    classed = seen.join(roots, ["h1", "h2"], "left").select(
        F.struct("id", "hash", "pos").alias("at"), F.coalesce("r1", "h1").alias("r1"), F.coalesce("r2", "h2").alias("r2")
    )
    classed = cut(classed, "classed")
    discard(seen, found, roots)
    first = classed.groupBy("r1", "r2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1").drop("n"), "first")
    extra = classed.join(first, ["r1", "r2"]).where(~F.col("at").eqNullSafe(F.col("first"))).select("at.*")
    drops = cut(extra.groupBy("id", "hash").agg(F.collect_set("pos").alias("drop")), "drops")
    discard(classed, first)
    return drops


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the text that is left, and a struct ``lines`` (total, dropped) added or replaced.

    Null text stays null, and lines shorter than min_chars (blank ones too) always stay.
    Rows equal in id and text lose the same lines. An empty table gives no rows.
    """
    drops = dropped_lines(docs, id_col, text_col, **options).select(
        F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("drop").alias("__drop")
    )
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    joined = keyed.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    # Only texts that lose lines are split; for the others the line breaks are counted.
    split = F.array(F.split(F.col(text_col), "\n"))
    kept = F.transform(split, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "__drop"), lambda i: F.get(x, i)))[0]
    breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    total = F.coalesce(breaks + 1, F.lit(0))
    count = F.struct(total.alias("total"), F.greatest(F.coalesce(F.size("__drop"), F.lit(0)), F.lit(0)).alias("dropped"))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    own = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "lines"]
    return joined.select(*own, count.alias("lines"))


def apply_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without repeated lines, with n_chars renewed if there is such a column.

    A document of which nothing but blank lines is left, all its lines being kept in other
    documents, is left out.
    """
    found = dedup_lines(docs.withColumnRenamed("lines", "__own_lines"), id_col, text_col, **options)
    gone = (F.col("lines.dropped") > 0) & (F.trim(F.regexp_replace(text_col, r"\s+", "")) == "")
    found = found.where(~F.coalesce(gone, F.lit(False))).drop("lines").withColumnRenamed("__own_lines", "lines")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)

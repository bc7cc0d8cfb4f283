"""Prefix trie of conversations, with subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns. It is known by its depth and by the XOR of
128-bit hashes of (position, role, text) over its turns, which is a running fold, so that
a conversation of any length can be folded in blocks.

The nodes that have one smallest member form a run down that conversation, since a prefix
of the smallest member cannot have a smaller one further down. Runs pass the messages:
each holds a counter of child runs that are still to come; runs without any send their
subtree totals to the node they hang on, counters go down, and so on until only the
root's run is left. There are no more rounds than turns in the longest conversation, and
the fold along each run gives the totals of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, discard

WIDTH = 4096  # turns of a conversation in a block
IDS = 1 << 16  # conversation ids in a block
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, at: str, columns: list[str], fold: Callable, join: Callable, back: bool = False) -> DataFrame:
    """rows, from a written table, with columns folded from the first ``at`` of each key on (back: from the last).

    at counts without gaps. Blocks of WIDTH rows are folded each on its own and then joined by
    what the blocks before them fold to, so no task holds more than a block of a key.
    """
    blocked = rows.withColumn("__block", F.expr(f"{at} div {WIDTH}"))
    way = (lambda c: F.col(c).desc()) if back else F.col
    inside = Window.partitionBy(key, "__block").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    outside = Window.partitionBy(key).orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(key, "__block").agg(*(fold(c).alias(f"__{c}") for c in columns))
    offsets = sums.select(key, "__block", *(fold(f"__{c}").over(outside).alias(f"__{c}") for c in columns))
    offsets = offsets.where(F.col(f"__{columns[0]}").isNotNull())
    folded = blocked.withColumns({c: fold(c).over(inside) for c in columns}).join(offsets, [key, "__block"], "left")
    whole = {c: join(F.col(c), F.coalesce(f"__{c}", F.lit(0))) for c in columns}
    return folded.withColumns(whole).select(*rows.columns)


def number_turns(turns: DataFrame) -> DataFrame:
    """id, nth (from 1, by turn, null first, then by hash), digest and size of every turn.

    turns: id, turn, role, text. Sorted by ranges, each numbered on its own after those of its
    conversation in the ranges before it, so that one conversation may span many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where("id is not null").select(
        "id", "turn", F.unhex(digest).alias("digest"), F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("roll")
    )
    ranged = rows.repartitionByRange("id", "turn", "digest", "roll").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged.drop("roll"), "turns")
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    numbered = ranged.withColumn("at", F.row_number().over(within)).join(starts, ["id", "part"])
    return numbered.select("id", (F.col("at") + F.col("before")).cast("long").alias("nth"), "digest", "size")


def share_beginnings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on their century's first one: (id, total), and (id, at, total, digest, size) of their turns.

    turns: numbered. Conversation c begins with the first h turns of c - c % every (all, if
    fewer; none, if it is not there) and goes on with its own after its first h;
    h is crc32 of c in decimals, modulo most. At most most - 1 turns are shared, and each
    first conversation with fewer than twice ``every`` others.
    """
    numbered = cut(turns, "numbered")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % most).alias("h")
    convs = numbered.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", "n", h, (F.col("id") - F.col("id") % every).alias("base"))
    convs = cut(convs, "lengths")
    firsts = convs.where(F.col("id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    total = shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = cut(convs.join(firsts, "base", "left").select("id", "base", "h", shared.alias("shared"), total.alias("total")), "convs")
    own = numbered.join(convs, "id").where("nth > h").select("id", (F.col("nth") - F.col("h") + F.col("shared")).alias("at"), "total", "digest", "size")
    lent = numbered.where((F.col("nth") < most) & (F.col("id") % every == 0)).select(F.col("id").alias("base"), F.col("nth").alias("at"), "digest", "size")
    lent = convs.join(lent, "base").where("at <= shared").select("id", "at", "total", "digest", "size")
    return convs.select("id", "total"), cut(own.unionByName(lent), "rebuilt")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which come in order; one row a node."""
    at, sha = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("at", "a", "b"), at, strict=True), ends=sha.hexdigest())], schema)

    schema = pa.schema([("at", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            where = r["at"], r["a"], r["b"]
            if where != at:
                if at is not None:
                    yield row()
                at, sha = where, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(r["chunk"].encode())
    if at is not None:
        yield row()


def _ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """at, a, b, ends: SHA-256 of the ids that end at a node, joined block by block of ids and then in order."""
    zero = F.lit(0).cast("long")
    last = steps.where("at = total").select("id", "at", "a", "b")
    last = last.unionByName(convs.where("total = 0").select("id", zero.alias("at"), zero.alias("a"), zero.alias("b")))
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    chunks = last.groupBy("at", "a", "b", F.floor(F.col("id") / IDS).alias("block")).agg(ids.alias("chunk"))
    sorted_ = chunks.repartition("at", "a", "b").sortWithinPartitions("at", "a", "b", "block").select("at", "a", "b", "chunk")
    return sorted_.mapInArrow(_digests, "at long, a long, b long, ends string")


def peel(runs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every run with the totals of its subtree (leaves, saved), and the written tables behind them.

    runs: id, up (the run that it hangs on, null for the root's), on (the node's depth), leaves, saved of its own nodes.
    """
    kids = runs.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("waits"))
    open_ = cut(runs.join(kids, "id", "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "runs")
    tables, done = [open_], open_.where("waits = 0")
    while True:
        sent = open_.where("waits = 0 and up is not null").groupBy(F.col("up").alias("id"))
        sent = sent.agg(F.count(F.lit(1)).alias("came"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = open_.where("waits > 0").join(sent, "id", "left")
        left = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        rest = rest.withColumns(left | {"waits": F.col("waits") - F.coalesce("came", F.lit(0))}).select(*open_.columns)
        open_ = cut(rest, "runs", free=False)
        tables.append(open_)
        if open_.isEmpty():
            return done.select("id", "up", "on", "leaves", "saved"), tables
        done = done.unionByName(open_.where("waits = 0"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: id, total (turns of it), each id once; turns: id, at (1 to total), total, digest of role and text, size.
    A node's members begin with its turns; saved_tokens sums (n_convs - 1) times size over its subtree.
    Conversations without turns belong to the root alone; without conversations there is no node.
    """
    xor = dict(fold=F.bit_xor, join=lambda x, y: x.bitwiseXOR(y))
    step = {c: F.xxhash64(F.lit(i), "at", "digest") for i, c in enumerate("ab")}
    own = turns.withColumns({f"own_{c}": v for c, v in step.items()} | step).drop("digest")
    steps = running(own, "id", "at", ["a", "b"], **xor)
    before = {f"up_{c}": F.col(c).bitwiseXOR(F.col(f"own_{c}")) for c in "ab"}
    steps = cut(steps.withColumns(before).drop("own_a", "own_b"), "steps")

    first = convs.agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).first()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.sparkSession.range(1 if first["n"] else 0).select(
        zero.alias("at"), zero.alias("a"), zero.alias("b"), F.lit(first["id"]).cast("long").alias("id"), F.lit(first["n"]).alias("n"), zero.alias("size"), none.alias("up_a"), none.alias("up_b")
    )
    grouped = steps.groupBy("at", "a", "b").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")
    )
    keyed = cut(grouped.unionByName(root), "keyed")
    above = keyed.where("at > 0").select((F.col("at") + 1).alias("at"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("id").alias("above"))
    up = F.when(F.col("at") == 1, F.lit(first["id"]).cast("long")).otherwise(F.col("above"))
    known = keyed.join(above, ["at", "up_a", "up_b"], "left").select("at", "a", "b", "id", "n", "size", up.alias("up"))
    known = cut(known, "known")
    kids = known.where("at > 0").groupBy(F.col("up").alias("id"), (F.col("at") - 1).alias("at")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = known.join(kids, ["id", "at"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    worth = {"leaves": (F.col("kids") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("size")}
    nodes = cut(nodes.join(_ends(steps, convs), ["at", "a", "b"], "left").withColumns(worth).drop("a", "b"), "nodes")

    hangs = F.max(F.when(F.col("up") != F.col("id"), F.col("up")))
    runs = nodes.groupBy("id").agg(hangs.alias("up"), (F.min("at") - 1).alias("on"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    done, tables = peel(runs)
    came = done.where("up is not null").groupBy(F.col("up").alias("id"), F.col("on").alias("at"))
    came = came.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    more = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
    met = cut(nodes.join(came, ["id", "at"], "left").withColumns(more).drop("more_leaves", "more_saved"), "met")
    discard(steps, keyed, known, nodes, *tables)
    found = running(met, "id", "at", ["leaves", "saved"], fold=F.sum, join=lambda x, y: x + y, back=True)
    return found.select(
        F.col("id").alias("conv_id"),
        F.col("at").alias("depth"),
        F.col("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of conversations rebuilt on shared beginnings (share_beginnings).

    Turns are ordered by turn, null first, equal ones by a hash of role and text, which need not
    be short; a null role or text is empty; repeated rows are turns of their own. Rows with a null
    id take no part. Only the four columns are read, whatever others there are. An empty table gives no node.
    """
    names = {"id": id_col, "turn": turn, "role": role, "text": text}
    turns = number_turns(conversations.select(*(F.col(f"`{c}`").alias(name) for name, c in names.items())))
    return prefix_trie(*share_beginnings(turns))

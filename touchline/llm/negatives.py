"""Hard negatives by exact inner-product search over one-dimensional distance keys.

Vectors get one more coordinate, sqrt(M^2 - |x|^2), M being the largest norm, so that a
larger inner product with an anchor is a smaller distance to it. Each row belongs to its
nearest pivot and is stored sorted by (pivot, distance to the pivot). By the triangle
inequality the rows within a radius of an anchor have keys within that radius of the
anchor's own distance to the pivot: an interval of keys, an annulus of space.

A round scans, for every open anchor, the annuli between the radius it has done and its
next one. Best rows found so far give the radius that would certify them, which is the next
one; an anchor is done when its radius is no less. Anchors are dealt in blocks to the key
ranges that their annuli meet, and scored there as products of matrices, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, discard

BLOCK = 1024  # rows of a block
RANGE = 1 << 17  # rows of a range of keys
ANCHORS = 256  # anchors of a block
SAMPLE = 4096  # rows that pivots are chosen from
SLACK = 1e-6  # share of a radius that rounding may cost
LEAST = -(1 << 62)


def whole_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double; null where the vector or a component is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & good, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


@dataclass
class Space:
    """Pivots in augmented space; m2, the largest squared norm; dims, of the vectors."""

    pivots: np.ndarray
    m2: int
    dims: int

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Vectors in a type in which products are exact: doubles, where no product can pass 2^53."""
        return rows.astype(np.float64 if self.m2 < 1 << 53 else np.int64)

    def keys(self, rows: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distance of each row, with its last coordinate, to each pivot."""
        cross = rows.astype(np.float64) @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1]
        own = (rows.astype(np.float64) ** 2).sum(1) + last**2
        return np.sqrt(np.maximum(own[:, None] + (self.pivots**2).sum(1) - 2 * cross, 0))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.m2 - (rows.astype(np.float64) ** 2).sum(1), 0))

    def radius(self, q2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a row has this score with an anchor of squared norm q2."""
        return np.sqrt(np.maximum(q2 + self.m2 - 2.0 * score, 0)) * (1 + SLACK) + SLACK


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrays of numbers as rows, zeros behind shorter ones."""
    out = np.zeros((len(column), dims), np.int64)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(starts)
    if len(flat):
        out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(starts[:-1], sizes)] = flat
    return out


def fit_space(points: DataFrame, pivots: int = 64, rounds: int = 5) -> Space:
    """Pivots from the SAMPLE rows of smallest hash, by farthest points and Lloyd's rounds; the bounds are over all rows."""
    norm = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
    top = points.agg(F.max(norm).alias("m2"), F.max(F.size("vec")).alias("dims")).first()
    space = Space(np.zeros((1, (top["dims"] or 0) + 1)), top["m2"] or 0, top["dims"] or 0)
    rows = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    if not len(rows):
        return space
    flat = _matrix(rows, space.dims)
    flat = np.concatenate([flat, space.lifted(flat)[:, None]], axis=1)
    centres, gap = [flat[0]], np.full(len(flat), np.inf)
    while len(centres) < min(pivots, len(flat)):
        gap = np.minimum(gap, ((flat - centres[-1]) ** 2).sum(1))
        if not gap.max():
            break
        centres.append(flat[gap.argmax()])
    space.pivots = np.array(centres)
    for _ in range(rounds):
        near = space.keys(flat[:, :-1], flat[:, -1]).argmin(1)
        for k in np.unique(near):
            space.pivots[k] = flat[near == k].mean(0)
    return space


def keyed(points: DataFrame, space: Space) -> DataFrame:
    """points (id, label, vec) with pivot and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(2), space.dims)
            far = space.keys(rows, space.lifted(rows))
            near = far.argmin(1) if len(rows) else np.zeros(0, np.int64)
            own = far[np.arange(len(rows)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(own)], [*batch.schema.names, "pivot", "distance"])

    return points.select("id", "label", "vec").mapInArrow(run, "id long, label long, vec array<long>, pivot int, distance double")


def _packed(dims: int, most: int):
    """Sorted rows as blocks of one pivot and ``most`` rows at most: lo and hi of the distance, ids (ascending), labels, distances and vectors."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        far = table["distance"].to_numpy()
        vectors = _matrix(table["vec"].combine_chunks(), dims)[order].astype(np.int64)
        if len(vectors) and abs(vectors).max(initial=0) < 1 << 31:
            vectors = vectors.astype(np.int32)
        columns = [ids[order], table["label"].to_numpy()[order], far[order], vectors]
        found = [table["pivot"][0].as_py(), float(far.min()), float(far.max()), len(ids), *(c.tobytes() for c in columns)]
        columns = [pa.array([v], pa.int32() if i == 0 else None) for i, v in enumerate(found)]
        return pa.RecordBatch.from_arrays(columns, ["pivot", "lo", "hi", "n", "ids", "labels", "distances", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            pivots = batch.column(batch.schema.get_field_index("pivot")).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(pivots))[0] + 1), len(pivots)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (size == most or pivots[a] != at):
                        yield block(held)
                        held, size = [], 0
                    take = min(b - a, most - size)
                    held.append(batch.slice(a, take))
                    size, at, a = size + take, pivots[a], a + take
        if held:
            yield block(held)

    return run


BLOCKS = "pivot int, lo double, hi double, n long, ids binary, labels binary, distances binary, vectors binary"


def build_index(points: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
    """Blocks of rows sorted by (pivot, distance) in shared files, and the (part, pivot) ranges of keys that they make up."""
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // RANGE))
    ranged = keyed(points, space).repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    blocks = cut(ranged.mapInArrow(_packed(space.dims, BLOCK), BLOCKS).withColumn("part", F.spark_partition_id()), "blocks")
    return blocks, blocks.groupBy("part", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@dataclass
class Wanted:
    """What a search looks for: k rows for each of an anchor's slots, of its label or of others, and the caps and floors of their scores."""

    same: bool
    k: int


def _scan(batches: Iterator[pa.RecordBatch], space: Space, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """Pairs of an anchor block and a block of rows; the best rows of each anchor and slot, for runs of pairs with one anchor block."""
    at, best = None, None
    names = ["anchor", "slot", "score", "id"]

    def told():
        anchors, score, ids = best
        a, s, k = np.nonzero(score > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(anchors[a]), pa.array(s.astype(np.int32)), pa.array(score[a, s, k]), pa.array(ids[a, s, k])], names)

    for batch in batches:
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            anchors, labels = (np.frombuffer(r[c], np.int64) for c in ("a_ids", "a_labels"))
            slots = len(r["a_caps"]) // (8 * len(anchors))
            caps, floors = (np.frombuffer(r[c], np.int64).reshape(len(anchors), slots) for c in ("a_caps", "a_floors"))
            done, reach = (np.frombuffer(r[c], np.float64) for c in ("a_done", "a_reach"))
            vectors = np.frombuffer(r["a_vectors"], np.int64).reshape(len(anchors), -1)
            if r["block"] != at:
                if at is not None:
                    yield told()
                at = r["block"]
                best = anchors, np.full((len(anchors), slots, wanted.k), LEAST, np.int64), np.zeros((len(anchors), slots, wanted.k), np.int64)
            ids, own, far = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), np.frombuffer(r["distances"], np.float64)
            rows = np.frombuffer(r["vectors"], np.int32 if len(r["vectors"]) == 4 * space.dims * len(ids) else np.int64).reshape(len(ids), -1)
            to = space.keys(vectors, np.zeros(len(anchors)))[:, r["pivot"]]
            near = np.maximum(np.maximum(far.min() - to, to - far.max()), 0)
            open_ = np.nonzero(near <= reach)[0]
            if not len(open_):
                continue
            gap = abs(to[open_, None] - far)
            fit = (gap <= reach[open_, None]) & (gap > done[open_, None])
            fit &= ((labels[open_, None] == own) & (anchors[open_, None] != ids)) if wanted.same else labels[open_, None] != own
            score = (space.exact(vectors[open_]) @ space.exact(rows).T).astype(np.int64)
            score[~fit] = LEAST
            order = np.argsort(-score, axis=1, kind="stable")  # ids ascend, so ties go to the smaller one
            score, ids = np.take_along_axis(score, order, 1), ids[order]
            for s in range(slots):
                low, high = floors[open_, s, None], caps[open_, s, None]
                place = (score > high).sum(1)[:, None] + np.arange(wanted.k)
                there = np.minimum(place, score.shape[1] - 1)
                new, who = np.take_along_axis(score, there, 1), np.take_along_axis(ids, there, 1)
                new = np.where((place < score.shape[1]) & (new >= low), new, LEAST)
                both = np.concatenate([best[1][open_, s], new], 1), np.concatenate([best[2][open_, s], who], 1)
                pick = np.lexsort((both[1], -both[0]), axis=1)[:, : wanted.k]
                best[1][open_, s], best[2][open_, s] = (np.take_along_axis(b, pick, 1) for b in both)
    if at is not None:
        yield told()


def _pack_anchors(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Anchors in blocks, with the ring of distances that their annuli cover around each pivot."""
    names = ["a_ids", "a_labels", "a_vectors", "a_caps", "a_floors", "a_done", "a_reach", "pivots"]
    for batch in batches:
        for start in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(start, ANCHORS)
            get = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            vectors = _matrix(get["vec"], space.dims)
            caps, floors = (np.array(get[c].to_pylist(), np.int64).reshape(part.num_rows, -1) for c in ("caps", "floors"))
            done, reach = get["done"].to_numpy(), get["reach"].to_numpy()
            to = space.keys(vectors, np.zeros(part.num_rows))
            rings = [{"pivot": p, "low": float((to[:, p] - reach).min()), "high": float((to[:, p] + reach).max())} for p in range(to.shape[1])]
            held = [get["id"].to_numpy(), get["label"].to_numpy(), vectors, caps, floors, done, reach]
            rings = pa.array([rings], pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(pa.array([np.ascontiguousarray(h).tobytes()]) for h in held), rings], names)


PACKED = "a_ids binary, a_labels binary, a_vectors binary, a_caps binary, a_floors binary, a_done binary, a_reach binary, pivots array<struct<pivot: int, low: double, high: double>>"


def best_rows(anchors: DataFrame, index: tuple[DataFrame, DataFrame], space: Space, wanted: Wanted) -> DataFrame:
    """id, slot, found: the first k (score, id) of each anchor and slot, best first, out of all rows.

    anchors, a written table: id, label, vec, caps and floors (of the scores of each slot).
    """
    blocks, ranges = index
    k, spark = wanted.k, anchors.sparkSession
    norm = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double")
    most = F.sqrt("q2") + F.lit(float(space.m2)) ** 0.5 + 1
    least = F.sqrt(F.greatest(F.lit(0.0), F.col("q2") + space.m2 - 2.0 * F.array_max("caps")))  # nothing nearer is wanted
    first = F.when(F.array_max("caps") > space.m2, most / 8).otherwise(F.greatest(least / 2, most / 8))
    state = anchors.withColumn("q2", norm).withColumns({"done": F.lit(-1.0), "reach": first, "most": most})
    state = state.withColumn("found", F.array().cast("array<struct<slot: int, score: long, id: long>>"))
    order = ["id", "label", "vec", "caps", "floors", "q2", "most", "found", "done", "reach"]
    state, finished = cut(state.select(*order), "anchors"), []
    while not state.isEmpty():
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        laid = keyed(state, space).select("id", "pivot", "distance").join(state, "id")
        laid = laid.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
        packed = laid.select("id", "label", "vec", "caps", "floors", "done", "reach").mapInArrow(lambda b: _pack_anchors(b, space), PACKED)
        packed = cut(packed.withColumn("block", F.monotonically_increasing_id()), "anchor_blocks", free=False)
        rings = packed.select("block", F.inline("pivots"))
        met = rings.join(ranges, "pivot").where("lo <= high and hi >= low").select("block", "part", "pivot")
        sent = met.join(packed.drop("pivots"), "block")
        pairs = sent.join(blocks, ["part", "pivot"])
        scored = pairs.mapInArrow(lambda b: _scan(b, space, wanted), "anchor long, slot int, score long, id long")
        scored = cut(scored, "scored", free=False)
        best = scored.groupBy(F.col("anchor"), "slot").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))), 1, k).alias("b"))
        best = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("slot", "b")).alias("by_slot"))
        new = F.expr("flatten(transform(by_slot, g -> transform(g.b, x -> struct(g.slot as slot, -x.s as score, x.i as id))))")
        both = F.concat("found", F.coalesce(new, F.array().cast("array<struct<slot: int, score: long, id: long>>")))
        slots = F.expr("sequence(0, size(caps) - 1)")
        top = F.expr(f"flatten(transform(__slots, s -> slice(array_sort(filter(__both, x -> x.slot = s), (x, y) -> case when x.score > y.score then -1 when x.score < y.score then 1 when x.id < y.id then -1 when x.id > y.id then 1 else 0 end), 1, {k})))")
        moved = state.join(best, "id", "left").withColumns({"__both": both, "__slots": slots}).withColumn("found", top)
        worst = F.expr(f"array_min(transform(__slots, s -> case when size(filter(found, x -> x.slot = s)) < {k} then floors[s] else array_min(transform(filter(found, x -> x.slot = s), x -> x.score)) end))")
        sure = F.least("most", F.sqrt(F.greatest(F.lit(0.0), F.col("q2") + space.m2 - 2.0 * worst.cast("double"))) * (1 + SLACK) + SLACK)
        moved = moved.withColumns({"done": F.col("reach"), "sure": sure})
        short = F.expr(f"exists(__slots, s -> floors[s] <= caps[s] and size(filter(found, x -> x.slot = s)) < {k})")
        moved = moved.withColumn("reach", F.when(short, F.least(F.col("sure"), F.col("done") * 2)).otherwise(F.col("sure")))
        moved = cut(moved.select(*order, "sure"), "anchors", free=False)
        finished.append(moved.where("done >= sure").select("id", "found"))
        discard(scored, packed, state)
        state = moved.where("done < sure").drop("sure")
    out = finished[0] if finished else state.select("id", "found")
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("id", F.inline("found").alias("slot", "score", "row"))


def mine(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors' hard negatives.

    Scores are inner products with the anchor of whole vectors (whole_vector of the column
    embedding by default); more comes first, ties go to the smaller id. Positives are the first rows of the
    anchor's label, negatives the first of other labels that score low to high per cent of the positive.
    Rows with a null id or label, or without a whole vector, take no part. Rows that repeat an
    id count once, with the smallest label and vector. Shorter vectors count as filled up with zeros. Other
    columns of rows may have any name. Without anchors, or an empty table, there are no rows.
    """
    label = F.col("label") if label is None else label
    vector = whole_vector(F.col("embedding")) if vector is None else vector
    points = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vec"), anchors.alias("asks"))
    points = points.where("id is not null and label is not null and vec is not null")
    points = points.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"), F.max("asks").alias("asks")).select("id", "row.*", "asks")
    points = cut(points, "points")
    space = fit_space(points)
    index = build_index(points, space)
    limits = {"caps": F.array(F.lit(1 << 61)), "floors": F.array(F.lit(-(1 << 61)))}
    asked = cut(points.where("asks").select("id", "label", "vec").withColumns(limits), "asked")
    found = cut(best_rows(asked, index, space, Wanted(True, positives)), "positives")

    exact = {"cap": F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100"), "floor": F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100")}
    bounds = found.withColumns(exact).where("floor <= cap")
    listed = bounds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("score"), F.col("row"), "cap", "floor"))).alias("p"))
    posed = asked.drop("caps", "floors").join(listed, "id")
    width = F.lit(positives)
    pad = {"caps": ("p.cap", -(1 << 60)), "floors": ("p.floor", 1 << 60)}
    for name, (field, fill) in pad.items():
        posed = posed.withColumn(name, F.concat(F.col(field), F.array_repeat(F.lit(fill), width - F.size("p"))))
    posed = cut(posed, "posed")
    hard = best_rows(posed.drop("p"), index, space, Wanted(False, negatives))
    given = posed.select("id", F.posexplode("p").alias("slot", "p")).select("id", "slot", F.col("p.row").alias("positive_id"), F.col("p.score").alias("positive_score"))
    nth = F.row_number().over(Window.partitionBy("id", "slot").orderBy(F.col("score").desc(), "row"))
    hard = hard.withColumn("rank", nth).withColumnRenamed("score", "negative_score")
    out = hard.join(given, ["id", "slot"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", "negative_score")


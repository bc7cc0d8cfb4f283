"""Exact top-k search: BM25 over inverted-index shards with block-max pruning.

A shard is an inverted index of a few thousand documents, bounded in documents and words: sorted term hashes, and for each
the places and frequencies of its documents. Document frequencies, the number of documents
and their mean length are global, so the scores of all shards compare and their best k
merge exactly.

Documents with like words are put into one shard, and documents of like length beside each
other, so that a block of documents has little in common with most queries. Which are alike is
learnt from some 4,096 beginnings of texts and decides only where a document stands: every
document is indexed, and the results do not depend on it.

A shard serves a block of queries at a time. Postings of a query's rare terms are added
up first. Its frequent terms are bounded, for each block of 64 documents, by their largest
impacts there; where that bound and the best rare sum of the block together do not reach
the query's k-th best score so far, the block is skipped. In the others the frequent terms
are added in single precision, which costs half, and what may then reach the k-th best
score is summed again in double precision. That score carries over from shard to shard within a task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, discard, small_batches

WORDS = re.compile(r"[^\W_]+")
SPACED = bytes(c if WORDS.match(chr(c)) else 32 for c in range(256))
BLOCK = 64
FREQUENT = 16  # a term is frequent in a shard if more than one document of so many has it
PANEL = 8  # blocks whose frequent terms are added at once
POSTINGS = 1 << 17  # of rare terms that are added at once, about
TILE = 256  # queries at a time
GROUPS, SAMPLE, BEGINNING = 8, 4096, 1024  # of documents: groups, documents that they are learnt from, characters looked at
FEW_DOCS = 1024  # that a shard has at least, if there are enough for all cores
PARTS = ("terms", "offsets", "places", "counts", "lengths", "ids")
KINDS = ("<u8", "<i4", "<u2", "<u4", "<i4", "<i8")
APART = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1}  # shards can be read by themselves
SPLIT = "spark.sql.files.maxPartitionBytes"
QUERY_PARTS = ("ids", "ends", "codes", "terms", "weights")
QUERY_KINDS = ("<i8", "<i8", "<i4", "<u8", "<f8")


def _words(text: str | None) -> list[str]:
    """WORDS of the lower-cased text; most texts are in Latin-1, where splitting at white space is faster."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def _term_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode(), 9) for w in words], np.uint64)


def _presence(texts: list[str | None], places: dict[str, int]) -> np.ndarray:
    found = np.zeros((len(texts), len(places)), np.float32)
    for row, text in enumerate(texts):
        found[row, [places[w] for w in set(_words(text)) if w in places]] = 1
    return found


def _learn_groups(texts: list[str | None]) -> tuple[dict[str, int], np.ndarray]:
    """The places of the most frequent words, and the centres of at most GROUPS groups, by k-means on the sphere."""
    df = Counter(w for t in texts for w in set(_words(t)))
    places = {w: i for i, (w, _) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:512])}
    rows = _presence(texts, places)
    rows = rows[rows.sum(axis=1) >= min(16, rows.sum(axis=1).max(initial=0))]
    rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    centres = rows[:1]
    while 0 < len(centres) < GROUPS:
        centres = np.vstack([centres, rows[(rows @ centres.T).max(axis=1).argmin()]])
    for _ in range(10):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.array([rows[own == g].sum(axis=0) for g in np.unique(own)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return places, centres


def _tasks(spark: SparkSession) -> int:
    """Tasks that serve the shards. One that serves many prunes more and returns less, so there are few for a core."""
    return max(16, 3 * spark.sparkContext.defaultParallelism)


def _arranged(rows: DataFrame, text_col: str, shard_docs: int, shard_words: int) -> tuple[DataFrame, int]:
    """The rows (id, text), dealt so that a partition makes about one shard, of documents with like words; and the number of partitions."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text_col)).alias("chars")).first()
    parts = max(size["n"] / shard_docs, (size["chars"] or 0) / (6 * shard_words)) / 0.85
    parts = int(max(parts, min(_tasks(rows.sparkSession), size["n"] / FEW_DOCS)))
    if parts < 2:
        return rows, 1
    beginning = F.substring(text_col, 1, BEGINNING)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(-(-size["n"] // SAMPLE))) == 0)
    texts = [r["beginning"] for r in sample.select(beginning.alias("beginning")).limit(2 * SAMPLE).collect()]
    places, centres = _learn_groups(texts)
    if not len(centres):
        return rows, 1
    n = np.bincount((_presence(texts, places) @ centres.T).argmax(axis=1), minlength=len(centres))
    n = np.maximum(1, np.round(n / n.sum() * parts)).astype(np.int64)
    starts = np.cumsum(n) - n

    @F.pandas_udf("int")
    def part(text: pd.Series, key: pd.Series) -> pd.Series:
        group = (_presence(text.tolist(), places) @ centres.T).argmax(axis=1)
        return pd.Series(starts[group] + key.to_numpy() % n[group])

    return rows.repartitionById(int(n.sum()), part(beginning, F.xxhash64("id"))), int(n.sum())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 6144, shard_words: int = 3 << 20) -> DataFrame:
    """A row of packed arrays for each shard, with n (documents) and words (their total length).

    A shard ends at shard_docs documents (65,536 at most) or shard_words words; a longer document ends its shard.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, parts = _arranged(rows, "text", shard_docs, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(ids: list[int], lengths: list[int], code: dict[str, int], codes: list[np.ndarray]) -> pa.RecordBatch:
            hashes = _term_hashes(list(code))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pair = rank[np.concatenate(codes)]
            pair <<= 16
            by_length = np.argsort(lengths, kind="stable")
            pair |= np.repeat(np.argsort(by_length), lengths)
            pair.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
            counts, pair = np.diff(first, append=len(pair)), pair[first]
            offsets = np.searchsorted(pair >> 16, np.arange(len(order) + 1))
            arrays = hashes[order], offsets, pair & 0xFFFF, counts, np.array(lengths)[by_length], np.array(ids)[by_length]
            packed = [pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, KINDS, strict=True)]
            sizes = [pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())]
            return pa.RecordBatch.from_arrays([*packed, *sizes], [*PARTS, "n", "words"])

        ids, lengths, code, codes, total = [], [], defaultdict(count().__next__), [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py())
                codes.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                ids.append(id_)
                lengths.append(len(words))
                total += len(words)
                if len(ids) == shard_docs or total >= shard_words:
                    yield shard(ids, lengths, code, codes)
                    ids, lengths, code, codes, total = [], [], defaultdict(count().__next__), [], 0
        if ids:
            yield shard(ids, lengths, code, codes)

    fields = [*(f"{p} binary" for p in PARTS), "n long", "words long"]
    index, tasks = rows.mapInArrow(run, ", ".join(fields)), _tasks(docs.sparkSession)
    if parts == 1:
        return index
    return index.repartitionById(min(parts, tasks), F.spark_partition_id())  # shards of all groups in each


def _document_frequencies(index: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, offsets in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(terms.as_py(), "<i8")
                n = np.diff(np.frombuffer(offsets.as_py(), "<i4")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["term", "df"])

    counted = index.select("terms", "offsets").mapInArrow(run, "term long, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def _query_terms(queries: DataFrame, at_once: int = 1 << 17) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            own = np.repeat(np.array(ids, np.int64), [len(t) for t in terms])
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(terms).view(np.int64))], ["query_id", "term"])

        ids, terms, total = [], [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(id_)
                terms.append(_term_hashes(list(set(_words(text.as_py())))))
                total += len(terms[-1])
                if total >= at_once:
                    yield made()
                    ids, terms, total = [], [], 0
        if ids:
            yield made()

    return queries.mapInArrow(run, "query_id long, term long").dropDuplicates(["query_id", "term"])


def _pack_queries(table: pa.Table) -> pa.Table:
    """The rows query_id, term, weight of a block as one row: a sparse matrix of queries and the block's sorted distinct terms."""
    ids, weights = table["query_id"].to_numpy(), table["weight"].to_numpy()
    terms, first, codes = np.unique(table["term"].to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    own, n = np.unique(ids, return_counts=True)
    arrays = own, np.concatenate([[0], np.cumsum(n)]), codes[order], terms, weights[first]
    packed = [pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, QUERY_KINDS, strict=True)]
    return pa.Table.from_arrays([table["block"].slice(0, 1), *packed], ["block", *QUERY_PARTS])


class QueryBlock:
    """Queries by their terms (codes[ends[q]:ends[q + 1]], places in terms), and the k best documents of each so far."""

    def __init__(self, parts: dict[str, bytes], k: int):
        arrays = [np.frombuffer(parts[p], kind) for p, kind in zip(QUERY_PARTS, QUERY_KINDS, strict=True)]
        self.ids, self.ends, self.codes, self.terms, self.weights = arrays
        self.k = k
        self.best = np.full((len(self.ids), k), -np.inf)  # by score, then id
        self.best_ids = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Documents of some queries, each document once."""
        own = np.unique(query)
        query = np.concatenate([np.repeat(own, self.k), query])
        score = np.concatenate([self.best[own].ravel(), score])
        ids = np.concatenate([self.best_ids[own].ravel(), ids])
        order = np.lexsort((ids, -score, query))
        starts = np.searchsorted(query[order], own)
        order = order[starts[:, None] + np.arange(self.k)]
        self.best[own], self.best_ids[own] = score[order], ids[order]

    def found(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.best > -np.inf)
        arrays = self.ids[query], self.best_ids[query, place], self.best[query, place]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_id", "id", "score"])


def search_shard(block: QueryBlock, part: dict[str, np.ndarray], mean_length: float, k1: float, b: float) -> None:
    """Merge the shard's documents into the block's best ones."""
    n, k = len(part["ids"]), block.k
    if not len(part["terms"]) or not len(block.terms):
        return
    at = np.minimum(np.searchsorted(part["terms"], block.terms), len(part["terms"]) - 1)
    found = part["terms"][at] == block.terms
    low = part["offsets"][at].astype(np.int64)
    df = np.where(found, part["offsets"][at + 1] - low, 0)
    idf = np.zeros(len(part["terms"]))
    idf[at[found]] = block.weights[found]
    norm = k1 * (1 - b + b * part["lengths"] / max(mean_length, 1e-9))
    postings = np.empty((len(part["places"]), 2))  # impact and place beside each other, as they are looked up at random
    impact, places = postings.T
    places[:] = part["places"]
    impact[:] = norm[part["places"]]
    impact += part["counts"]
    np.divide(part["counts"] * (k1 + 1), impact, out=impact)
    impact *= np.repeat(idf, np.diff(part["offsets"]))

    dense = np.flatnonzero(df > max(8, n // FREQUENT))
    column = np.full(len(df), -1, np.int32)
    column[dense] = np.arange(len(dense))
    length = df.copy()
    length[dense] = 0
    blocks = -(-n // BLOCK)
    width = blocks * BLOCK
    frequent = np.zeros((width, len(dense)))
    for row, t in enumerate(dense):
        own = slice(low[t], low[t] + df[t])
        frequent[part["places"][own], row] = impact[own]
    single, slack = frequent.T.astype(np.float32, order="C"), 1 + (len(dense) + 4) * 2.0**-22  # of sums in single precision, all terms being positive
    largest = frequent.reshape(blocks, BLOCK, len(dense)).max(axis=1).T

    for first in range(0, len(block.ids), TILE):
        size = min(TILE, len(block.ids) - first)
        ends = block.ends[first : first + size + 1]
        code, query = block.codes[ends[0] : ends[-1]], np.repeat(np.arange(size), np.diff(ends))
        own = np.flatnonzero(column[code] >= 0)
        wanted = np.zeros((size, len(dense)), np.float32)
        wanted[query[own], column[code[own]]] = 1
        sums = np.zeros((size, width))
        own = np.flatnonzero(length[code])
        upto = np.cumsum(length[code[own]])
        for some in np.split(own, np.searchsorted(upto, np.arange(POSTINGS, upto[-1] if len(upto) else 0, POSTINGS))):
            term = code[some]
            each = length[term]
            posting = np.repeat(low[term] - np.cumsum(each) + each, each)
            posting += np.arange(len(posting))
            found = postings.take(posting, axis=0)
            cell = np.repeat(query[some] * width, each)
            cell += found[:, 1].astype(np.intp)
            np.add.at(sums.reshape(-1), cell, found[:, 0])
        rare = sums.reshape(size, blocks, BLOCK).max(axis=2)
        limit = block.best[first : first + size, -1]
        if blocks >= k:  # k sets of documents, far from each other, have one each that scores as much
            limit = np.maximum(limit, np.partition(sums.reshape(size, BLOCK, blocks).max(axis=1), blocks - k, axis=1)[:, blocks - k])
        limit = np.where(limit > 0, limit / slack**2 - 2e-6, 0.0)  # scores are rounded to six decimals
        alive = wanted.astype(np.float64) @ largest + rare >= limit[:, None]
        total = np.zeros((size, width), np.float32)
        for s in range(0, blocks, PANEL):
            some, cols = np.flatnonzero(alive[:, s : s + PANEL].any(axis=1)), slice(s * BLOCK, (s + PANEL) * BLOCK)
            if len(some) == size:
                total[:, cols] = wanted @ single[:, cols] + sums[:, cols]
            elif len(some):
                total[some, cols] = wanted[some] @ single[:, cols] + sums[some, cols]
        tops, total = total.reshape(size, blocks, BLOCK).max(axis=2), total.reshape(size, BLOCK, blocks)
        if blocks >= k:
            limit = np.maximum(limit, np.partition(total.max(axis=1), blocks - k, axis=1)[:, blocks - k] / slack**2 - 2e-6)
        total = total.reshape(size, blocks, BLOCK)
        query, s = np.nonzero((tops >= limit[:, None]) & (tops > 0))
        one, other = np.nonzero((total[query, s] >= limit[query, None]) & (total[query, s] > 0))
        query, doc = query[one], s[one] * BLOCK + other
        for start in range(0, len(query), 1 << 12):
            q, d = query[start : start + (1 << 12)], doc[start : start + (1 << 12)]
            score = sums[q, d] + np.einsum("ij,ij->i", wanted[q].astype(np.float64), frequent[d])
            block.merge(q + first, np.round(score, 6), part["ids"][d])


def search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    block_queries: int = 8192,
    block_terms: int = 1 << 21,
) -> DataFrame:
    """query_id, rank, id_col, score: the k best documents of every query (id_col, text_col), exactly.

    A query is the set of distinct words of its whole text. Scores are rounded to six
    decimals; equal ones rank by id. Documents that share no word with a query are not
    found. Null ids are left out on both sides; null texts match nothing. Queries of one id
    are one query of all their words; documents of one id are found each. Other columns are
    left out, whatever their names, and an empty table gives no rows. Queries are served in
    blocks of about block_queries queries and block_terms words at most (one query is never
    divided), each against all shards by a job of its own, so the driver holds one block at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = cut(build_index(docs, id_col, text_col), "index", **APART)
    totals = index.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()[0]
    n, words = totals["n"] or 0, totals["words"] or 0
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_col)
    terms = cut(_query_terms(asked), "terms")
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(_document_frequencies(index), "term").select("query_id", "term", idf.alias("weight"))
    blocks = max(-(-asked.count() // block_queries), -(-terms.count() // block_terms))
    weighted = weighted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    kinds = ", ".join(f"{p} binary" for p in QUERY_PARTS)
    packed = cut(weighted.groupBy("block").applyInArrow(_pack_queries, f"block long, {kinds}"), "queries")
    shards = index.select(*PARTS).coalesce(_tasks(spark))
    mean_length, found = words / max(1, n), []
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, f"{16 << 20}b")  # about a shard, so that the tasks get as many each
    try:
        for number in range(blocks):
            for row in packed.where(F.col("block") == number).collect():  # one row of a bounded number of queries
                sent = spark.sparkContext.broadcast({p: bytes(row[p]) for p in QUERY_PARTS})

                def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                    block = QueryBlock(sent.value, k)
                    for batch in batches:
                        for i in range(batch.num_rows):
                            part = {p: np.frombuffer(batch.column(j)[i].as_py(), kind) for j, (p, kind) in enumerate(zip(PARTS, KINDS, strict=True))}
                            search_shard(block, part, mean_length, k1, b)
                    yield block.found()

                found.append(cut(shards.mapInArrow(run, "query_id long, id long, score double"), "hits"))
                sent.destroy()
    finally:
        spark.conf.set(SPLIT, before)
    if not found:
        found = [spark.createDataFrame([], "query_id long, id long, score double")]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = cut(ranked.select("query_id", "rank", F.col("id").alias(id_col), "score"), "ranked")
    discard(index, terms, packed, *found)
    return ranked

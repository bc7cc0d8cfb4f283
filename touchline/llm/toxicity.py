"""Toxicity by class-conditional Kneser-Ney word models.

One bigram model is fitted to toxic and one to ordinary texts. Both discount by absolute
amounts, every count by the same, and back off to the bigram counts of both classes
together, then to their class's continuation counts (in how many distinct contexts a word
stands), and these to counts that both classes share: what either was discounted. So a
context that only one class has met is no evidence by itself. A text's log-likelihood ratio is
taken per word, as a mean over the text, as the largest mean over a window, and for the square
root of its length; a logistic function fitted on rows that were not counted turns these
into a score, both classes weighing the same.

A document's mean alone ranks few toxic documents right where single words make them toxic:
the README gives the figures, and why the score looks at the words of the largest ratio too.

The models are fitted on a bounded sample of labelled rows, max_docs of each class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, discard

WORDS = re.compile(r"[^\W\d_]+")
WINDOW = 32
STRONG = 2.0
LIMIT = 5.0  # no word counts for more than this log-ratio
GROUP = 1 << 19  # words scored at once
START = 0  # stands for the word before the first
DISCOUNT = 0.75
BIGRAMS = 1 << 18  # bigrams put into the model at once
FETCHED = 1 << 19  # bigrams brought to the driver at once, about


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def word_hashes(distinct: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 4) | 1 for w in distinct], np.uint64)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bigram_counts(sample: DataFrame) -> DataFrame:
    """first, second, n1, n0 over rows (text, toxic): after how many distinct words each bigram stands in toxic and other rows.

    Copies of a text repeat its contexts and so add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(label, held):
            own = list({w for gram in held for w in gram if w})
            code = dict(zip(own, word_hashes(own).view(np.int64).tolist(), strict=True)) | {"": START}
            grams = list(held)
            columns = [pa.array([label] * len(grams), pa.int32())]
            columns += [pa.array([code[g[k]] for g in grams], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["toxic", "before", "first", "second"])

        for batch in batches:
            held = {0: set(), 1: set()}
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = words(text.as_py())
                held[label].update(zip(["", "", *own], ["", *own], own, strict=False))
                if len(held[label]) > GROUP:
                    yield emit(label, held[label])
                    held[label] = set()
            for label, grams in held.items():
                if grams:
                    yield emit(label, grams)

    grams = sample.select("text", "toxic").mapInArrow(run, "toxic int, before long, first long, second long")
    bad = F.col("toxic")
    return grams.distinct().groupBy("first", "second").agg(F.sum(bad).cast("int").alias("n1"), F.sum(1 - bad).cast("int").alias("n0"))


def _fetched(counts: DataFrame, rows_each: int = FETCHED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, second, n1 and n0 of all bigrams, brought to the driver some hundred thousand at a time, so that Spark and Arrow never hold them all there."""
    table = cut(counts, "bigrams")
    n = table.count()
    out = (np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.int32), np.empty(n, np.int32))
    parts, low = max(1, -(-n // rows_each)), 0
    for k in range(parts):
        some = table.where(F.pmod(F.xxhash64("first", "second"), F.lit(parts)) == k).toArrow()
        for column, name in zip(out, ("first", "second", "n1", "n0"), strict=True):
            values = some[name].to_numpy()
            column[low : low + len(values)] = values.view(column.dtype)
        low += some.num_rows
    discard(table)
    return out


def fit_model(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hash arrays with log-ratios of words, contexts and bigrams, from all bigrams (hashes) and their class counts."""
    counts = {"1": n1, "0": n0}
    word, place = np.unique(second, return_inverse=True)
    ctx, of = np.unique(first, return_inverse=True)
    place, of = place.astype(np.int32), of.astype(np.int32)
    p, left, given = {}, {}, np.zeros(len(word))
    total_given = 0.0
    for c in "10":  # what a class takes from a count is what the shared counts get
        n = np.bincount(place[counts[c] > 0], minlength=len(word))
        whole, taken = max(1, n.sum()), np.minimum(n, DISCOUNT)
        p[c] = (n - taken) / whole
        left[c] = max(1e-9, 1 - p[c].sum())
        given += taken
        total_given += left[c] * whole
    for c in "10":
        p[c] = p[c] + left[c] * given / total_given
    total, rest = {}, {}
    for c in ("1", "0", "both"):
        n = n1 + n0 if c == "both" else counts[c]
        total[c] = np.maximum(np.bincount(of, n, len(ctx)), 1)
        rest[c] = np.maximum(1 - np.bincount(of, np.maximum(n - DISCOUNT, 0), len(ctx)) / total[c], 1e-9)
    key, bi = np.empty(len(first), np.uint64), np.empty(len(first), np.float32)
    for low in range(0, len(first), BIGRAMS):
        some = slice(low, low + BIGRAMS)
        at, to, logp = of[some], place[some], {}
        shared = np.maximum(n1[some] + n0[some] - DISCOUNT, 0) / total["both"][at]
        for c in "10":
            lower = shared + rest["both"][at] * p[c][to]
            logp[c] = np.log(np.maximum(counts[c][some] - DISCOUNT, 0) / total[c][at] + rest[c][at] * lower)
        key[some], bi[some] = pair_hash(first[some], second[some]), logp["1"] - logp["0"]
    order = np.argsort(key)
    return {
        "word": word,
        "uni": np.log(p["1"]) - np.log(p["0"]),
        "unseen": np.array([np.log(left["1"]) - np.log(left["0"])]),
        "context": ctx,
        "back": np.log(rest["1"]) - np.log(rest["0"]),
        "pair": key[order],
        "bi": bi[order],
        "weights": np.zeros(0),
    }


def _look(table: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], default)


def features(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """For each text, of the log-ratios of its words: mean, largest mean over a window, sum and sum of
    what exceeds STRONG, both over the root of the length; then 1."""
    out = np.zeros((len(texts), 5))
    out[:, 4] = 1
    held: list[list[str]] = []
    owner: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if i < len(texts):
            own = words(texts[i])
            if own:
                held.append(own)
                owner.append(i)
                size += len(own)
        if held and (i == len(texts) or size >= GROUP):
            flat = np.empty(size, object)
            flat[:] = [w for own in held for w in own]
            index, distinct = pd.factorize(flat)
            hashes = word_hashes(distinct.tolist())
            lengths = np.array([len(own) for own in held])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            now = hashes[index]
            before = np.concatenate([[np.uint64(START)], now[:-1]])
            before[starts] = START
            uni = _look(model["word"], model["uni"], hashes, model["unseen"][0])[index]
            back = _look(model["context"], model["back"], hashes, 0.0)[index]
            start_back = _look(model["context"], model["back"], np.array([START], np.uint64), 0.0)[0]
            ratio = uni + np.concatenate([[start_back], back[:-1]])
            ratio[starts] = uni[starts] + start_back
            ratio = np.clip(_bigram_ratio(model, before, now, hashes, index, ratio), -LIMIT, LIMIT)
            run = np.concatenate([[0.0], np.cumsum(ratio)])
            for k, i_ in enumerate(owner):
                low, n = starts[k], lengths[k]
                total = run[low + n] - run[low]
                span = min(n, WINDOW)
                means = (run[low + span : low + n + 1] - run[low : low + n + 1 - span]) / WINDOW
                strong = np.maximum(ratio[low : low + n] - STRONG, 0).sum() / np.sqrt(n)
                out[i_, :4] = total / n, means.max(), total / np.sqrt(n), strong
            held, owner, size = [], [], 0
    return out


def _bigram_ratio(model, before, now, hashes, index, ratio):
    """ratio, replaced where the bigram itself is in the model."""
    if not len(model["pair"]):
        return ratio
    first = np.isin(hashes, model["context"])[index]
    at = np.nonzero(np.concatenate([[False], first[:-1]]) | (before == START))[0]
    keys = pair_hash(before[at], now[at])
    place = np.minimum(np.searchsorted(model["pair"], keys), len(model["pair"]) - 1)
    hit = model["pair"][place] == keys
    ratio[at[hit]] = model["bi"][place[hit]]
    return ratio


def scores(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    if not len(model["weights"]):
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip((features(model, texts) / model["scale"]) @ model["weights"], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method; the rows of either class weigh the same together."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge * len(y) * np.eye(len(w)) / 10, x.T @ (share * (y - p)) - ridge * len(y) / 10 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 10_000):
    """The model, from labels (id_col, toxic 0 or 1) and the texts of docs.

    Each class gives all its rows, max_docs at most, those of the smallest hashes of their
    ids. A fifth of them is not counted but fits the logistic function. The driver holds all
    bigrams of the rest, which max_docs bounds. Ids with several labels count
    as toxic if one says so; null labels, ids and texts are left out. Without labels of
    both classes all scores are 0.
    """
    spark = docs.sparkSession
    known = labels.where(f"toxic in (0, 1) and `{id_col}` is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("id", F.lit(4))
    sample = [known.where(F.col("toxic") == c).orderBy(draw, "id").limit(max_docs) for c in (0, 1)]
    sample = sample[0].union(sample[1])  # at most 2 * max_docs ids, so the join may broadcast them
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(sample), "id").select("text", F.col("toxic").cast("int").alias("toxic"), "id")
    aside = F.xxhash64("id", F.lit(5)).bitwiseAND(1023) < 205
    model = fit_model(*_fetched(_bigram_counts(rows.where(~aside))))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(sent.value, batch.column(0).to_pylist())
            columns = [batch.column(1), *(pa.array(found[:, k].copy()) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "x0", "x1", "x2", "x3"])

    found = rows.where(aside).mapInArrow(run, "toxic int, x0 double, x1 double, x2 double, x3 double").toPandas()
    sent.destroy()
    y = found["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.column_stack([found[["x0", "x1", "x2", "x3"]].to_numpy(float), np.ones(len(y))])
        model["scale"] = np.append(np.maximum(x[:, :4].std(axis=0), 1e-9), 1.0)
        model["weights"] = logistic(x / model["scale"], y)
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray], columns: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """columns of docs (default: all) and the score of every whole text.

    Null or wordless texts have all features 0. A column named score is replaced. Equal rows
    get equal scores, an empty table gives no rows, and the arrays of a long text are as long as it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*(columns or [F.col(f"`{c}`") for c in docs.columns])).columns
    picked = docs.select(*(columns or [F.col(f"`{c}`") for c in docs.columns]), F.col(text_col).alias("__text"))
    picked = picked.select(*(f"`{c}`" for c in own if c != "score"), "__text")
    at = len(picked.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(sent.value, batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], found], [*batch.schema.names[:at], "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:at]]
    return picked.mapInArrow(run, ", ".join([*fields, "score double"]))

"""Language identification with interpolated Kneser-Ney character models.

Characters are letters and marks in lower case; everything else is one space. An n-gram
of up to four characters is an exact 64-bit number, 16 bits a character. For each order
the model is a sorted array of such numbers and a matrix of log-probabilities with a
column for each language, interpolated down to the uniform distribution; contexts have a
matrix of back-off weights alike. A text is scored by the distinct n-grams of its batch,
found by binary search, and gets the language of least cross-entropy a character.

The models are fitted on a bounded sample: about max_docs rows of each language, chosen
by a hash of the row. A fifth of the sample is not counted but scored, and sets each
language's limit of cross-entropy above which a text is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from touchline.llm.common import small_batches

ORDER = 4
PIECE = 1 << 18  # characters handled at once
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each UTF-16 unit: its lower case if it is a letter or mark, else a space."""
    table = np.full(1 << 16, 32, np.uint16)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """The number of the four characters that end at each character of the text; runs of spaces are one."""
    units = table[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]
    units = np.concatenate([units, np.array([32], np.uint16)])
    space = units == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    units = units[keep].astype(np.uint64)
    padded = np.concatenate([np.full(ORDER - 1, 32, np.uint64), units])
    out = padded[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        out |= padded[ORDER - 1 - back : len(padded) - back] << np.uint64(16 * back)
    return out


def _ngram_counts(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, code, n: n-grams of the highest order, added up within each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own, size = [], 0
                for i in [*np.nonzero(langs == lang)[0], -1]:
                    if i >= 0:
                        own.append(grams(texts[i], table))
                        size += len(own[-1])
                    if own and (i < 0 or size > PIECE):
                        codes, n = np.unique(np.concatenate(own), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())],
                            ["lang", "code", "n"],
                        )
                        own, size = [], 0

    counted = rows.select(text_col, lang_col).mapInArrow(run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in the sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


@dataclass
class Model:
    """codes[n], logp[n]: n-grams of order n and a column for each language; contexts[n], backoff[n] of their contexts."""

    langs: list[str]
    codes: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    backoff: dict[int, np.ndarray]
    floor: float
    limits: np.ndarray | None = None

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of distinct n-grams of the highest order, by language."""
        out = np.zeros((len(codes), len(self.langs)))
        left = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            part = codes[left] & _mask(order) if order < ORDER else codes[left]
            at, there = _find(self.codes[order], part)
            out[left[there]] += self.logp[order][at[there]]
            left, part = left[~there], part[~there]
            if len(left):
                at, there = _find(self.contexts[order], part >> np.uint64(16))
                out[left[there]] += self.backoff[order][at[there]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, and its number of characters."""
        total, length = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0
        for i in range(len(texts) + 1):
            if i < len(texts):
                codes = grams(texts[i], table)
                length[i] = len(codes)
                for at in range(0, len(codes), PIECE):
                    held.append(codes[at : at + PIECE])
                    owner.append(i)
                    size += len(held[-1])
            if held and (i == len(texts) or size >= PIECE):
                index, distinct = pd.factorize(np.concatenate(held))
                found = self.look_up(distinct)
                starts = np.cumsum([0, *(len(h) for h in held[:-1])])
                for k in range(len(self.langs)):
                    np.add.at(total[:, k], owner, np.add.reduceat(found[index, k], starts))
                held, owner, size = [], [], 0
        return -total / np.maximum(length, 1)[:, None], length

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        some = [i for i, t in enumerate(texts) if t and has_letter(t)]
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if some and self.langs:
            entropy, length = self.entropies([texts[i] for i in some], table)
            best = entropy.argmin(axis=1)
            lead = (entropy.min(axis=1)[:, None] - entropy) * (64 * length / (64 + length))[:, None]
            scores[some] = 1 / np.exp(lead).sum(axis=1)
            limit = np.inf if self.limits is None else self.limits[best] + 8 / np.sqrt(length)
            rejected[some] = entropy.min(axis=1) > limit
            for i, k in zip(some, best, strict=True):
                langs[i] = self.langs[k]
        return langs, scores, rejected


def fit_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from counts of the highest order, (codes, n) by language."""
    langs = sorted(counts)
    by_order: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {ORDER: {}}
    for lang in langs:
        codes, n = counts[lang]
        order = np.argsort(codes)
        by_order[ORDER][lang] = codes[order], n[order].astype(float)
    for order in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters in front
        by_order[order] = {
            lang: (lambda u: (u[0], u[1].astype(float)))(np.unique(codes & _mask(order), return_counts=True))
            for lang, (codes, _) in by_order[order + 1].items()
        }
    codes, logp, contexts, backoff = {}, {}, {}, {}
    empty = np.array([], np.uint64)
    alphabet = len(np.unique(np.concatenate([empty, *(c for c, _ in by_order[1].values())])))
    floor, below = 1.0 / (alphabet + 1), None
    for order in range(1, ORDER + 1):
        every = np.unique(np.concatenate([empty, *(c for c, _ in by_order[order].values())]))
        context = np.unique(every >> np.uint64(16))
        p, lam = np.zeros((len(every), len(langs))), np.ones((len(context), len(langs)))
        lower = np.full((len(every), 1), floor) if order == 1 else below[_find(codes[order - 1], every & _mask(order - 1))[0]]
        for k, lang in enumerate(langs):
            own, n = by_order[order][lang]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, n1 / (n1 + 2 * n2)) if n1 and n2 else 0.75
            of = np.searchsorted(context, own >> np.uint64(16))
            total, kinds = np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context))
            seen = total > 0
            lam[seen, k] = discount * kinds[seen] / total[seen]
            p[np.searchsorted(every, own), k] = np.maximum(n - discount, 0) / total[of]
        p += lam[np.searchsorted(context, every >> np.uint64(16))] * lower
        codes[order], contexts[order], below = every, context, p
        logp[order], backoff[order] = np.log(np.maximum(p, 1e-300)), np.log(lam)
    return Model(langs, codes, logp, contexts, backoff, float(np.log(floor)))


def _predicted(model: Model, rows: DataFrame, columns: list[Column], text_col: str) -> DataFrame:
    """columns of rows, with lang_pred, score, rejected and (for calibration) the entropy in each language."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))
    own = [c for c in rows.select(*columns).columns if c not in ("lang_pred", "score", "rejected")]
    picked = rows.select(*columns, F.col(text_col).alias("__text")).select(*(f"`{c}`" for c in own), "__text")
    kept = picked.drop("__text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = letter_table(), Model(**sent.value)
        for batch in batches:
            at = batch.num_columns - 1
            langs, scores, rejected = model.predict(batch.column(at).to_pylist(), table)
            added = [pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)]
            names = [*batch.schema.names[:at], "lang_pred", "score", "rejected"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *added], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return picked.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))


def fit(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 5000, quantile: float = 0.999, max_langs: int = 1000
) -> Model:
    """Models from rows of known language; rows without text, language or letters are left out.

    About max_docs rows of each language are counted or calibrated on (all, where there
    are fewer), whole texts each, drawn by a hash of all their columns and bounded by
    twice as many, so that copies of one text do not come in or stay out
    together. More than max_langs languages raise an error. No rows: a model without
    languages, which predicts ``und``.
    """
    small_batches(rows.sparkSession)
    own = F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() not in ("map", "variant")))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), own.alias("own"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than max_langs={max_langs} languages")
    if not sizes:
        return fit_counts({})
    draw = F.xxhash64("own", F.lit(6)).bitwiseAND((1 << 30) - 1)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1, max_docs / n) * (1 << 30)))))
    few = Window.partitionBy("lang").orderBy("draw", "own")
    sample = rows.withColumn("draw", draw).where(F.col("draw") <= share[F.col("lang")])
    sample = sample.withColumn("__nth", F.row_number().over(few)).where(F.col("__nth") <= 2 * max_docs)  # rows alike in all columns draw alike
    aside = F.xxhash64("own", F.lit(7)).bitwiseAND(1023) < 205
    counted = _ngram_counts(sample.where(~aside), "text", "lang").toPandas()  # bounded by the sample
    counts = {
        lang: (own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy()) for lang, own in counted.groupby("lang")
    }
    model = fit_counts(counts)
    if model.langs:
        sent = rows.sparkSession.sparkContext.broadcast(vars(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, model = letter_table(), Model(**sent.value)
            for batch in batches:
                some = [(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
                some = [(t, x) for t, x in some if x in model.langs]
                if some:
                    entropy, length = model.entropies([t for t, _ in some], table)
                    own = entropy[np.arange(len(some)), [model.langs.index(x) for _, x in some]]
                    excess = own - 8 / np.sqrt(length)
                    yield pa.RecordBatch.from_arrays([pa.array([x for _, x in some]), pa.array(excess)], ["lang", "excess"])

        scored = sample.where(aside).mapInArrow(run, "lang string, excess double")
        rows_ = scored.groupBy("lang").agg(F.percentile("excess", quantile).alias("limit"), F.stddev("excess").alias("spread")).collect()
        limits = {r["lang"]: r["limit"] + 4 * (r["spread"] or 0.0) for r in rows_}
        model.limits = np.array([limits.get(lang, np.inf) for lang in model.langs])
    return model


def identify(docs: DataFrame, model: Model, columns: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """columns of docs (default: all), lang_pred, score, rejected for every row.

    lang_pred is ``und``, the score 0 and the row rejected where the text is null or has
    no letter. score is the posterior of the language, the text's length n counting as
    64 n / (64 + n) characters. Columns of these three names are replaced. Equal rows get equal
    results, an empty table gives no rows, and long texts are scored whole, in pieces.
    rejected: the text fits its language worse than the calibrated limit allows.
    """
    return _predicted(model, docs, columns or [F.col(f"`{c}`") for c in docs.columns], text_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs, each sent once."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = letter_table(), Model(**sent.value)
        for batch in batches:
            rejected = model.predict(batch.column(at).to_pylist(), table)[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in docs.schema]))

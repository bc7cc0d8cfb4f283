"""Best-fit packing of tokenized documents into sequences, by non-negative least squares.

Lengths are counted in units of ``unit`` tokens, rounded up. All patterns of up to three
lengths that fill a sequence are enumerated, and the repeat count of each is fitted to the
histogram of lengths by non-negative least squares; the histogram has as many rows as
there are units in a sequence, whatever the input. Pieces are dealt by hash into shards of
bounded size. Each shard rounds the repeat counts down to its share, fills those patterns,
and packs what is left by best fit, largest first, into the room that is left anywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut

SUFFIX = ".,;:!?*%$#&|-()\"/"  # never letters, digits or apostrophes: the tokenizer splits before them
LATIN = re.compile("[a-zß-öø-ÿ]+")  # letters of one byte or two, which the tokenizer leaves as they are
#: Letters that the tokenizer turns into a letter and a mark, which joins the punctuation after it.
MARKED = "[\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e]"
CACHE_WORDS = 200_000  # of each of two caches
LONG_WORD = 256  # characters above which a word is not kept
TOGETHER = 1 << 21  # bytes above which texts are not encoded together


def _gather(table: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of table that are named by code, in turn, and where each begins; size: of each entry, which stand in order."""
    n = size[code]
    ends = np.append(0, np.cumsum(n))
    return table[np.repeat((np.cumsum(size) - size)[code] - ends[:-1], n) + np.arange(ends[-1])], ends


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, with bounded caches of words.

    The tokenizer never joins what white space separates, nor letters and the punctuation
    after them, and takes capital letters for small ones. So a text's ids are those of its
    words in turn, and a word's are those of its letters, A to Z as a to z, and of the rest.

    A word that is asked for moves from the older cache to the newer. When the newer is full,
    it takes the place of the older, so frequent words are always known.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: split(chr(c))[0][0] for c in range(ord("ß"), ord("ÿ") + 1)}  # as the model has them
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of new words: Latin letters by the model itself, other letters all at once, other words one by one."""
        found, latin, other = [b""] * len(words), [], []
        ids, bounds = [], [0]
        for i, w in enumerate(words):
            low = w.lower()
            if LATIN.fullmatch(low):
                ids += [token.id for token in self.model.tokenize(low if low.isascii() else low.translate(self.letters))]
                latin.append(i)
                bounds.append(4 * len(ids))
            elif w.isalpha():
                other.append(i)
            else:
                found[i] = self.whole(w)
        raw = np.array(ids, "<u4").tobytes()
        for k, i in enumerate(latin):
            found[i] = raw[bounds[k] : bounds[k + 1]]
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            encoded = self.tokenizer.encode(" ".join(words[i] for i in part), add_special_tokens=False)
            ids, of = np.array(encoded.ids, "<u4"), np.array(encoded.word_ids, np.int64)
            starts = np.nonzero(np.diff(of, prepend=-1))[0]
            raw, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            one_each = len(starts) == len(part)  # else a letter's lower case is not only letters
            for k, i in enumerate(part):
                found[i] = raw[bounds[k] : bounds[k + 1]] if one_each else self.whole(words[i])
        return found

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of each of some different words, none of them letters with punctuation after them."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        found, new = list(map(self.cache.get, words)), []
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.older.get(words[i])
                if ids is None:
                    new.append(i)
                else:
                    found[i] = self.cache[words[i]] = ids
        for i, ids in zip(new, self.learn([words[i] for i in new]), strict=True):
            found[i] = ids
            if len(words[i]) <= LONG_WORD:
                self.cache[words[i]] = ids
        return found

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after the other, and how many each has."""
        core = pc.utf8_rtrim(words, SUFFIX)
        letters = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(core, MARKED))
        low = pc.if_else(letters, pc.ascii_lower(words), words)  # as long as before
        length = pc.if_else(letters, pc.binary_length(core), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        start = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
        cuts = np.empty(2 * len(low) + 1, np.int32)  # each word in two: what is looked up by itself, and the rest
        cuts[::2], cuts[1::2] = start, start[:-1] + length
        coded = pa.StringArray.from_buffers(2 * len(low), pa.py_buffer(cuts), low.buffers()[2]).dictionary_encode()
        each = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, ends = _gather(np.frombuffer(b"".join(each), "<u4"), size, coded.indices.to_numpy())
        return ids, np.diff(ends[::2])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of a few texts, none null: each different word is looked up once, the rest is done on numbers."""
        texts = texts.cast(pa.string())
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        coded = split.flatten().dictionary_encode()
        ids, ends = _gather(*self.words(coded.dictionary), coded.indices.to_numpy())
        offsets = split.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]].tolist()
        return [self.whole(texts[i].as_py()) if odd[i] else ids[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))]


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """From which to which text to encode together."""
    ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + TOGETHER, "right")) - 1)
        yield low, high
        low = high


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(content: str) -> WordEncoder:
    """One encoder for each worker process, which outlives its tasks."""
    if content not in _ENCODERS:
        _ENCODERS[content] = WordEncoder(content)
    return _ENCODERS[content]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, salt (and ids) of every document's pieces of at most capacity tokens.

    Null text counts as empty, and an empty text is the end id alone. salt is the row's
    number in its task, which spreads equal rows over shards.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, at_row = _encoder(sent.value), np.array([end_id], "<u4").tobytes(), 0
        for whole in batches:
            for low, high in _portions(whole.column(1)):
                batch = whole.slice(low, high - low)
                owner, piece, start, length, crc, tokens = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(batch.column(1))):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        owner.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            tokens.append(np.frombuffer(part, "<u4").astype(np.int32))
                salt = np.arange(at_row, at_row + len(owner), dtype=np.int64)
                at_row += len(owner)
                columns = [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(salt),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "salt"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, fields)


def patterns(units: int, most: int = 3) -> np.ndarray:
    """Rows of up to ``most`` lengths in units, largest first and padded by 0, that fill a sequence."""
    found: list[tuple[int, ...]] = [(units,)]
    open_: list[tuple[int, ...]] = [(a,) for a in range(1, units)]
    for _ in range(most - 1):
        grown = [(*p, b) for p in open_ for b in range(1, min(p[-1], units - sum(p)) + 1)]
        found += [p for p in grown if sum(p) == units]
        open_ = [p for p in grown if sum(p) < units]
    return np.array([p + (0,) * (most - len(p)) for p in found])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative x of least ||a x - b||, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, np.abs(b).max(initial=0.0))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        passive[best] = True
        while True:
            own = np.nonzero(passive)[0]
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[own] = s
                break
            down = s <= 0
            step = (x[own][down] / np.maximum(x[own][down] - s[down], 1e-30)).min()
            x[own] += step * (s - x[own])
            passive[own[(x[own] <= 1e-12) & down]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def fit_patterns(histogram: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns with a positive repeat count, and the counts; histogram[u - 1] pieces are u units long."""
    units = len(histogram)
    rows = patterns(units, most)
    rows = rows[(np.append(histogram > 0, True)[rows - 1]).all(axis=1)]  # 0 is padding and looks up the last entry
    if not len(rows):
        return rows, np.zeros(0)
    a = np.zeros((units, len(rows)))
    for column in rows.T:
        np.add.at(a, (column[column > 0] - 1, np.nonzero(column > 0)[0]), 1.0)
    scale = max(1.0, float(histogram.max(initial=1)))
    x = nnls(a, histogram / scale) * scale
    return rows[x > 0], x[x > 0]


def pack_shard(lengths: np.ndarray, rows: np.ndarray, repeats: np.ndarray, unit: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: whole patterns first, then best fit of the rest, largest first."""
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    by_unit: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable"):  # popped from the end: the longest of a unit first
        by_unit.setdefault(int(-(-lengths[i] // unit)), []).append(int(i))
    used: list[int] = []
    for row, n in zip(rows.tolist(), repeats.tolist(), strict=True):
        parts = [u for u in row if u]
        for _ in range(min([int(n), *(len(by_unit.get(u, ())) // parts.count(u) for u in parts)])):
            at = 0
            for u in parts:
                i = by_unit[u].pop()
                sequence[i], offset[i] = len(used), at
                at += int(lengths[i])
            used.append(at)
    free: dict[int, list[int]] = {}
    mask = 0
    for s, at in enumerate(used):
        free.setdefault(capacity - at, []).append(s)
        mask |= 1 << (capacity - at)
    left = sorted((i for own in by_unit.values() for i in own), key=lambda i: -lengths[i])
    for i in left:
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            s = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, s = capacity, len(used)
            used.append(0)
        sequence[i], offset[i] = s, capacity - room
        free.setdefault(room - n, []).append(s)
        mask |= 1 << (room - n)
    return sequence, offset


def pack(found: DataFrame, capacity: int = 4096, unit: int = 16, most: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """The rows of pieces() with sequence_id and offset, and without salt; no row is left out.

    found is read twice, so it should be a written table. An empty table gives no rows.
    """
    units = capacity // unit
    counted = found.groupBy(F.ceil(F.col("length") / unit).alias("u")).count().collect()  # units rows at most
    histogram = np.zeros(units)
    for r in counted:
        histogram[r["u"] - 1] = r["count"]
    rows, repeats = fit_patterns(histogram, most)
    total = int(histogram.sum())
    shards = max(1, round(total / shard_rows))
    drop = [c for c in found.columns if c not in ("salt",)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "salt"], kind="stable").reset_index(drop=True)
        share = np.floor(repeats * (len(frame) / max(1, total)))
        sequence, offset = pack_shard(frame["length"].to_numpy(), rows, share, unit, capacity)
        out = frame[drop].copy()
        out["sequence_id"] = frame["shard"].to_numpy(np.int64) * (1 << 32) + sequence
        out["offset"] = offset
        return out

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "salt"), F.lit(shards)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "salt"]
    return dealt.groupBy("shard").applyInPandas(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every document's pieces with their place: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut(pieces(docs, tokenizer_path, id_col, text_col), "pieces")
    return pack(found, **options).withColumnRenamed("id", id_col)

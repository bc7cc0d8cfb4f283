import inspect
import random

from pyspark.sql import functions as F

from tests.llm.helpers import documents, hard_texts, union_find
from touchline.llm import lines


def grams(line, n=7):
    units = line.encode("utf-16-le", "surrogatepass")
    return {units[2 * i : 2 * (i + n)] for i in range(len(units) // 2 - n + 1)}


def brute(texts, threshold=0.8):
    """The texts with the lines that stay: the first of each component by document and position."""
    at = {(i, k): raw.strip(lines.BLANK) for i, t in enumerate(texts) for k, raw in enumerate((t or "").split("\n"))}
    at = {p: x for p, x in at.items() if len(x) >= 20}
    distinct = sorted(set(at.values()))
    sets = [grams(x) for x in distinct]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    root = union_find(range(len(sets)), pairs)
    of = {x: root[i] for i, x in enumerate(distinct)}
    seen, drop = set(), set()
    for p in sorted(at):
        (drop if of[at[p]] in seen else seen).add(p if of[at[p]] in seen else of[at[p]])
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in enumerate(texts)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 40))) for _ in range(40)]
    texts = []
    for _ in range(n):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(20))
            if rng.random() < 0.5:
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice("XYZ") + line[k + 1 :]
            own.append(rng.choice(["", "  "]) + line)
        texts.append("\n".join([*own, "short", ""]))
    return texts


def test_matches_brute_force(spark):
    texts = corpus(1)
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_large_bucket_of_lines_apart(spark, monkeypatch):
    """Blocks give the same as single pairs where buckets are large."""
    texts = corpus(2, 80)
    monkeypatch.setattr(lines, "FEW_LINES", 1)
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_hard_rows_and_clashing_columns(spark):
    texts = hard_texts()
    docs = documents(spark, texts, ids=[None, *range(1, len(texts))])
    found = lines.dedup_lines(docs)
    assert [c for c in found.columns if c != "lines"] == [c for c in docs.columns if c != "lines"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(texts) and rows[None]["text"] is None and rows[2]["text"] == " \n\t "
    assert rows[4]["text"] == texts[4] and rows[5]["text"] == "" and rows[6]["text"] == ""
    kept = lines.apply_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, *range(1, len(texts))} - {5, 6}


def test_empty_table(spark):
    assert lines.dedup_lines(documents(spark, ["x"]).limit(0)).count() == 0


def test_repeated_rows_keep_the_same_lines(spark):
    docs = documents(spark, ["a line that is long enough to count here"] * 2, ids=[1, 1])
    assert [r[0] for r in lines.dedup_lines(docs).select(F.col("lines.dropped")).collect()] in ([0, 0], [1, 1])


def test_banding_finds_similar_lines():
    """Of pairs at or little above the threshold, at least 0.9 share a band; most share one by far."""
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    first, second = [], []
    while len(first) < 400:
        own = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        other = list(own)
        for _ in range(rng.randint(1, 2)):
            other[rng.randrange(len(other))] = rng.choice(words)
        a, b = " ".join(own), " ".join(other)
        x, y = ({t[i : i + 7] for i in range(len(t) - 6)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.86:
            first.append(a)
            second.append(b)
    options = {"shingle": 7} | {k: v.default for k, v in inspect.signature(lines.dropped_lines).parameters.items() if k in ("bands", "rows")}
    one, two = (lines.band_keys(some, options["shingle"], options["bands"], options["rows"]) for some in (first, second))
    assert (one == two).any(axis=1).mean() >= 0.9


def test_counting_lines_splits_no_text(spark):
    """Lines are counted by their breaks; only texts that lose lines are split."""
    texts = [*corpus(3, 10), None, "", "\n", "a\n\nb\n"]
    found = lines.dedup_lines(documents(spark, texts)).select("doc_id", "lines")
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["lines"]["total"] for r in found.collect()} == {i: len(t.split("\n")) if t is not None else 0 for i, t in enumerate(texts)}


def test_texts_of_lines_with_blank_ends(spark):
    """Lines are trimmed and measured as by str.strip and len, whatever their ends and bytes."""
    some = ["a line that is long enough", "é" * 20, "é" * 19, "😀" * 20, "😀" * 19, "x" * 19, "\u00a0" + "y" * 19, "", " "]
    raw = [a + x + b for x in some for a in ("", " ", "\t \x0b", "\x0c") for b in ("", " ", "\r", " \r\t")]
    docs = documents(spark, ["\n".join(raw), None])
    want = {x for x in (r.strip(lines.BLANK) for r in raw) if len(x) >= 20}
    wanted = spark.createDataFrame([(x,) for x in want], "line string").select(F.xxhash64("line").alias("h1"))
    assert sorted(r["line"] for r in lines._texts(docs, "text", 1, wanted).collect()) == sorted(want)
    assert sorted(r["line"] for r in lines._texts(docs, "text", 20, wanted).collect()) == sorted(want)

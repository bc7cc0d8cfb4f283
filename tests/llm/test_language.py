import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import documents, hard_texts
from touchline.llm import language, queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op6_language(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        doc = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in doc["text"] or ""))
        if r["held_out"] and doc["lang"] and r["lang_pred"] != "und":
            total += 1
            right += r["lang_pred"] == doc["lang"]
    print(right, total, right / total)
    assert right >= 0.97 * total


def test_hard_rows(spark):
    texts = hard_texts()
    docs = documents(spark, texts, langs=[None, "en", *["de", "en"] * 4, "fr"][: len(texts)])
    model = language.fit(docs)
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert (found[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")), text
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {0, 1, 2, 7}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200 and lang is not null")
    model = language.fit(docs)
    share = language.keep_identified(docs, model).count() / docs.count()
    print("kept", share)
    assert share > 0.98


def test_model_sums_to_one():
    """Over all characters seen after a context, and the rest of the alphabet, probabilities add up to 1."""
    import numpy as np

    table = language.letter_table()
    counts = {}
    for lang, text in (("x", "abracadabra arcade " * 5), ("y", "banana bandana cabana")):
        codes, n = np.unique(language.grams(text, table), return_counts=True)
        counts[lang] = codes, n
    model = language.fit_counts(counts)
    letters = sorted({int(c) & 0xFFFF for c in model.codes[1]})
    context = int(language.grams("abr", table)[2]) & ((1 << 48) - 1)
    codes = np.array([(context << 16 | c) & ((1 << 64) - 1) for c in letters], np.uint64)
    unknown = np.array([(context << 16 | 0x7A) & ((1 << 64) - 1)], np.uint64)  # z is in neither text
    total = np.exp(model.look_up(codes)).sum(axis=0) + np.exp(model.look_up(unknown))[0]
    assert 0x7A not in letters and (abs(total - 1) < 1e-6).all()


def test_copies_do_not_decide_the_draw_and_names_may_clash(spark):
    rows = [(i, "the same words again and again", "en", 0.5, "x") for i in range(400)] + [(1000 + i, f"other texte numero {i}", "fr", 0.5, "y") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.fit(docs, max_docs=50)
    assert model.langs == ["en", "fr"]
    found = language.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"] and found.count() == len(rows)


def test_probabilities_are_textbook_kneser_ney():
    """Against interpolated Kneser-Ney written out over strings, for every character after every context."""
    import math
    from collections import Counter

    import numpy as np

    table = language.letter_table()
    texts = {"x": "abracadabra arcade " * 3 + "cab dab", "y": "banana bandana cabana arc", "z": "abab ba b"}
    counts = {}
    for lang, text in texts.items():
        codes, n = np.unique(language.grams(text, table), return_counts=True)
        counts[lang] = codes, n
    model = language.fit_counts(counts)
    alphabet = {c for t in texts.values() for c in t + " "}

    def textbook(lang):
        padded = "   " + texts[lang] + " "
        grams = {4: Counter(padded[i : i + 4] for i in range(len(padded) - 3))}
        for order in (3, 2, 1):  # lower orders count the distinct characters in front
            grams[order] = Counter(g[1:] for g in grams[order + 1])
        discount = {}
        for order, own in grams.items():
            n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
            discount[order] = min(0.95, n1 / (n1 + 2 * n2)) if n1 and n2 else 0.75

        def p(gram):
            if not gram:
                return 1 / (len(alphabet) + 1)
            own, d = grams[len(gram)], discount[len(gram)]
            after = [v for g, v in own.items() if g[:-1] == gram[:-1]]
            if not after:
                return p(gram[1:])
            return max(own[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

        return p

    rng = np.random.default_rng(2)
    asked = {"".join(rng.choice(sorted(alphabet), 4)) for _ in range(200)} | {t[i : i + 4] for t in texts.values() for i in range(len(t) - 3)}
    asked = sorted(asked)
    codes = np.array([sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(g)) for g in asked], np.uint64)
    found = model.look_up(codes)
    for k, lang in enumerate(model.langs):
        p = textbook(lang)
        for g, value in zip(asked, found[:, k], strict=True):
            assert math.isclose(math.exp(value), p(g), rel_tol=1e-9), (lang, g)


def test_texts_are_sent_once_and_in_small_batches(spark):
    """No batch that goes to Python exceeds 8 MB by more than a row, and none holds a text twice."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from touchline.llm import common

    before = spark.conf.get(common.BATCH_BYTES)
    spark.conf.set(common.BATCH_BYTES, "64m")
    try:
        docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('quiet rivers carry words ', 400)").alias("text"))
        docs = docs.withColumn("lang", F.lit("en"))
        model = language.fit(docs.limit(50))
        model.limits = None  # nothing with letters is rejected
        kept = language.keep_identified(docs, model)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert len(sizes) > 3 and max(r["n"] for r in sizes) < (8 << 20) + 20_000
        sent = kept._jdf.queryExecution().analyzed().children().head().output().size()
        assert sent == len(docs.columns)
        assert kept.count() == 4000 and kept.columns == docs.columns
        spark.conf.set(common.BATCH_BYTES, "1m")
        language.identify(docs, language.fit(docs.limit(50)))
        assert spark.conf.get(common.BATCH_BYTES) == "1m"
    finally:
        spark.conf.set(common.BATCH_BYTES, before)


def test_kept_rows_have_their_columns_whatever_their_names_and_kinds(spark):
    """Rows are those that are not rejected, nested and odd columns included."""
    from pyspark.sql import functions as F

    docs = documents(spark, hard_texts() + ["plain words of a language that is known well"] * 3)
    docs = docs.withColumn("score", F.struct(F.col("doc_id").alias("a b"), F.array(F.col("doc_id")).alias("rejected")))
    docs = docs.withColumn("a b", F.current_timestamp()).withColumn("rejected", F.create_map(F.lit("x"), F.col("doc_id")))
    model = language.fit(docs.drop("rejected"))
    kept = language.keep_identified(docs, model)
    wanted = {r["doc_id"] for r in language.identify(docs, model, [F.col("doc_id")]).collect() if not r["rejected"]}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows} == wanted and len(rows) == len(wanted)
    assert all(r["score"]["a b"] == r["doc_id"] and r["rejected"] == {"x": r["doc_id"]} for r in rows)

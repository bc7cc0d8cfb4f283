import corpus_pipeline
from tests.llm.helpers import documents, hard_texts
from touchline.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    columns, table, counts = docs.columns, docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == columns
        table = spark.createDataFrame(table.collect(), table.schema)
        counts.append(table.count())
    assert counts[0] <= docs.count() and counts[2] <= counts[1] <= counts[0] and counts[2] > docs.count() / 4
    prints = {simhash.fingerprint(r["text"]) for r in table.collect()}
    for a in prints:
        assert not any(a != b and (a ^ b).bit_count() <= 2 for b in prints)


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        table = spark.createDataFrame(table.collect(), table.schema)
    kept = [r["text"] for r in table.collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["piece"]), []).append(r)
    assert sum(1 for r in rows if r["piece"] == 0) == len(kept)


def test_hard_rows_and_empty_table(spark):
    docs = documents(spark, hard_texts())
    some = hard_texts()[4]
    for table in (docs, docs.limit(0)):
        texts = {}
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF)
            if name != "packing":
                assert table.columns == docs.columns
                texts[name] = [r["text"] for r in table.select("text").collect()]
            table = spark.createDataFrame(table.collect(), table.schema)
        assert not any(t is None or not any(c.isalpha() for c in t) for t in texts["language_id"])
        assert texts["line_dedup"].count(some) == min(1, texts["language_id"].count(some))
        assert texts["simhash_dedup"].count(some) == texts["line_dedup"].count(some)
        assert table.where("piece = 0").count() == len(texts["source_mix"])
        assert (table.count() == 0) == (not texts["language_id"])

"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Language identification drops documents it rejects; line dedup keeps one line of each
group of equal or nearly equal ones; SimHash keeps one document of each near-duplicate
group; mixing takes documents, some more than once, towards the sources' target weights;
packing cuts the mix into token sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchline.llm import language, lines, mixing, packing, simhash
from touchline.llm.common import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise, models being fitted on docs themselves.

    Rejected: null, empty and letterless texts, and texts unlike every learned language. Copies
    of a row fare alike; an empty table gives an empty one. Columns as in docs, whatever their names.
    """
    return language.keep_identified(docs, language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one line left of each group of equal or nearly equal ones, n_chars renewed.

    Lines under 20 characters and null texts stay as they are; a document of which only blank lines
    are left goes. Ties go to the smallest doc_id, then the smallest text hash and position.
    """
    return lines.apply_dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at two or fewer differing bits.

    The smallest doc_id stays (of equal ids one text, by hash). Null and empty texts share the
    fingerprint zero, so one of them stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs once for each time the mix takes them, towards the sources' target weights.

    Documents without words weigh nothing and are left out; a null source is a source of its own.
    A document may come up to three times, under its own doc_id.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 4096 tokens.

    Null and empty texts are one end token; repeated rows are packed each on their own.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # models, MinHash and fitted patterns have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/touchline/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

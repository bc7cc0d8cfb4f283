"""A keyed table in buckets, of which an upsert rewrites only those that its keys fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.sources.folders import written

BUCKET = "__bucket"


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write rows, one a key, in buckets of the keys."""
    _bucketed(rows, keys, buckets).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert(changes: DataFrame, path: str, keys: list[str], buckets: int, latest: list[Column]) -> int:
    """Put changes into the table: of the rows of a key the first by ``latest`` stays. The number of buckets written.

    Buckets without a change are neither read nor written. The new rows of the others are written
    aside first and then moved in by a dynamic partition overwrite, so that a failed upsert changes nothing.
    """
    spark = changes.sparkSession
    new = written(_bucketed(changes, keys, buckets), "changes")
    touched = sorted(r[BUCKET] for r in new.select(BUCKET).distinct().collect())  # as many as there are buckets, at most
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(*new.columns)
    ranked = old.unionByName(new).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest)))
    merged = written(ranked.where("__rank = 1").drop("__rank"), "merged")
    merged.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return len(touched)

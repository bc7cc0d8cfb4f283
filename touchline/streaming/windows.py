"""Event-time windows over tracks, the same for batch and streaming tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, window: Column, keys: list[str], late: str | None = None) -> DataFrame:
    """n and the summed hundredths of value in each window and group; late: how long a stream waits for late rows."""
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    found = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "cents")


def read_changes(spark: SparkSession, folder: str, schema, key: str, value, files_each: int = 16) -> DataFrame:
    """Rows of one session from a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder).where(F.col(key) == value)


def control_stream(control: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Possession counts of every session, kept up to date: each batch's counts are appended under its number, so replays overwrite."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("session_id", "team").agg(F.count(F.lit(1)).alias("frames"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return control.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def control_totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("session_id", "team").agg(F.sum("frames").alias("frames"))


def in_turns(chunks: list[DataFrame], folder: str, stream: Callable[[], StreamingQuery] | None = None) -> None:
    """Chunks written one after another as folders ``turn=0``, ``turn=1`` and so on, each by as many tasks as it has partitions.

    stream: starts a query on the folder, which is run to its end after every turn; with one
    checkpoint it goes on where it stopped, so a turn is one batch and state is carried on.
    """
    for number, chunk in enumerate(chunks):
        chunk.write.parquet(f"{folder}/turn={number}")
        if stream:
            stream().awaitTermination()


def carried_switches(control: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """frames and switches of possession of every session so far, and the team last in control (0: none), with the state carried from chunk to chunk.

    control: session_id, at (what orders rows), team. Chunks must arrive in order; within a
    chunk rows are sorted. Every batch sums up its chunk, adds it to the state that the batch before it left, and writes the state of all
    sessions under its own number, so a replay starts from the same state.
    """
    none = F.lit(0).cast("long")
    held = F.when(F.col("team") != 0, F.col("team"))
    before = Window.partitionBy("session_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("__prior", F.last(held, ignorenulls=True).over(before))
        when = F.when(F.col("team") != 0, F.col("at"))  # rows without a team don't count
        own = marked.groupBy("session_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(held != F.col("__prior")).alias("s"), F.min_by("team", when).alias("one"), F.max_by("team", when).alias("other")
        )
        if number == 0:
            state = own.select("session_id", F.col("n").alias("frames"), F.col("s").alias("switches"), F.coalesce("other", F.lit(0)).alias("last"))
        else:
            kept = batch.sparkSession.read.schema("session_id long, frames long, switches long, last int").parquet(f"{out}/batch={number - 1}")
            across = ((F.col("last") != 0) & (F.col("one") != F.col("last"))).cast("long")
            state = kept.join(own, "session_id", "full").select(
                "session_id",
                (F.coalesce("frames", none) + F.coalesce("n", none)).alias("frames"),
                (F.coalesce("switches", none) + F.coalesce("s", none) + F.coalesce(across, none)).alias("switches"),
                F.coalesce("other", "last", F.lit(0)).alias("last"),
            )
        state.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return control.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_batch(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The last row that the batches wrote for each key."""
    rows = spark.read.option("basePath", out).parquet(out)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("last")).select(key, "last.*")


def copy_stream(rows: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """What arrives, appended to a Parquet table, each row once."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_then_tail(snapshot: DataFrame, tail: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest version of each row of a snapshot and of what was tailed since."""
    ranked = snapshot.unionByName(tail).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")

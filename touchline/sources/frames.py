"""Tracks laid out for scans: partitioned by a bucket of the session, sorted by session and frame.

A scan of some sessions reads their buckets alone, and of these only the row groups whose
sessions and frames can be asked for, because both filters reach the Parquet reader.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 26  # rows of a bucket, about
FILE_ROWS = 1 << 22  # rows of a file, about


def bucket(session: Column, buckets: int) -> Column:
    """CRC-32 of the session's text, so that a driver can work it out for a session without a job."""
    return F.pmod(F.crc32(session.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def lay_out(tracks: DataFrame, path: str, session: str = "session_id", order: str = "frame", buckets: int | None = None, **options) -> None:
    """Write tracks in buckets, in as many files as their rows ask for; a session of any length spreads over files by frame."""
    rows = tracks.count()
    buckets = buckets or max(1, rows // BUCKET_ROWS)
    files = max(buckets, -(-rows // FILE_ROWS))
    laid = tracks.withColumn("bucket", bucket(F.col(session), buckets))
    laid = laid.repartitionByRange(files, "bucket", session, order).sortWithinPartitions("bucket", session, order)
    laid.write.options(**options).partitionBy("bucket").parquet(path)


def scan(
    spark: SparkSession,
    path: str,
    start: int | None = None,
    end: int | None = None,
    stride: int = 1,
    sessions: Iterable[int] | None = None,
    buckets: int | None = None,
    session: str = "session_id",
    order: str = "frame",
) -> DataFrame:
    """Frames from start, before end, every stride-th counted from start, of some sessions or all.

    sessions and frames are compared as they are stored, so both comparisons are pushed to the files;
    only the stride is looked at row by row. buckets: how many lay_out() was told to use, which
    leaves the folders of other buckets unread.
    """
    rows = spark.read.parquet(path)
    if sessions is not None:
        wanted = sorted(set(sessions))
        rows = rows.where(F.col(session).isin(wanted))
        if buckets:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(str(s).encode()) % buckets for s in wanted})))
    if start is not None:
        rows = rows.where(F.col(order) >= start)
    if end is not None:
        rows = rows.where(F.col(order) < end)
    if stride > 1:
        rows = rows.where((F.col(order) - (start or 0)) % stride == 0)
    return rows.drop("bucket")

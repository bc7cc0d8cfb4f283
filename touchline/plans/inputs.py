"""Tracking and job-store tables as projections of the driver's tables, in Spark and as SQL.

``TABLES_SQL`` opens every SQL text of the catalogue: it names the same projections for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: All ages are counted up to this moment, so that reruns agree.
NOW = "2001-09-01 00:00:00"

TABLES_SQL = """
with tracks as (
  select user_id as session_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as frame,
         event_id as track_id, case event_type when 'purchase' then 1 when 'signup' then 2 else 0 end as team, value as speed,
         cast((event_id * 7919) % 12000 as integer) as mx, cast((event_id * 104729) % 7000 as integer) as my
  from events
), pitch as (
  select cast(floor(event_id / 11000) as bigint) as session_id, cast(floor(event_id / 22) as bigint) % 500 as frame,
         event_id % 22 as track_id, case when event_id % 22 < 11 then 1 else 2 end as team, value as speed,
         cast((event_id * 7919) % 12000 as integer) as x, cast((event_id * 104729) % 7000 as integer) as y
  from events
), totals as (
  select session_id, max(frame) + 1 as total_frames from tracks group by session_id
), segments as (
  select session_id, 'first_half' as type, 0 as start_frame, cast(floor(total_frames * 0.45) as integer) as end_frame from totals
  union all select session_id, 'halftime', cast(floor(total_frames * 0.45) as integer), cast(floor(total_frames * 0.55) as integer) from totals
  union all select session_id, 'second_half', cast(floor(total_frames * 0.55) as integer), total_frames from totals
), sessions as (
  select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at, o_totalprice as size, o_orderpriority as name,
         case o_orderstatus when 'F' then 'tracking_failed' when 'O' then 'tracking' else 'analysis_done' end as status
  from orders
), tasks as (
  select l_orderkey as session_id, l_linenumber as line, l_partkey as part, l_returnflag as task_type, l_shipdate as created_at,
         case l_linestatus when 'O' then 'running' else 'done' end as status
  from lineitem
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scrambled(factor: int, modulus: int) -> Column:
    return ((F.col("event_id") * factor) % modulus).cast("int")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame of each session (a user): track_id, team, speed, mx and my in centimetres."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    team = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        (F.row_number().over(order) - 1).alias("frame"),
        F.col("event_id").alias("track_id"),
        team.alias("team"),
        F.col("value").alias("speed"),
        scrambled(7919, 12000).alias("mx"),
        scrambled(104729, 7000).alias("my"),
    )


def pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 22 players in two teams, 500 frames a session, with x and y in centimetres."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(event / 11000).cast("long").alias("session_id"),
        (F.floor(event / 22).cast("long") % 500).alias("frame"),
        (event % 22).alias("track_id"),
        F.when(event % 22 < 11, 1).otherwise(2).alias("team"),
        F.col("value").alias("speed"),
        scrambled(7919, 12000).alias("x"),
        scrambled(104729, 7000).alias("y"),
    )


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each session; a row is a frame, so they are counted without numbering them."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id"))
    return rows.agg(F.count(F.lit(1)).cast("int").alias("total_frames"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_half, halftime and second_half of each session, at 45 and 55 per cent of its frames."""
    first, second = (F.floor(F.col("total_frames") * share).cast("int") for share in (0.45, 0.55))
    rows = [("first_half", F.lit(0), first), ("halftime", first, second), ("second_half", second, F.col("total_frames"))]
    made = F.array(*(F.struct(F.lit(t).alias("type"), a.alias("start_frame"), b.alias("end_frame")) for t, a, b in rows))
    return totals(spark, sf_dir).select("session_id", F.inline(made))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "tracking_failed").when(F.col("o_orderstatus") == "O", "tracking").otherwise("analysis_done")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderpriority").alias("name"),
        status.alias("status"),
    )


def tasks(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Tasks of sessions. placed: with file and row, their place in the table, which breaks ties of rows that are alike in all else that orders them."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if placed else []
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("task_type"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "O", "running").otherwise("done").alias("status"),
        *place,
    )


class Registry:
    """Queries by name, with the SQL that must give the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a query under its function's name. sql follows TABLES_SQL: a select, or more tables after a comma."""

        def add(function):
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = TABLES_SQL + sql
            return function

        return add

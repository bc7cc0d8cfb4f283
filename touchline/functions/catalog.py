"""SQL functions of the job store, for sessions that work in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

MAP = "map<string, string>"
FUNCTIONS = (
    f"""create or replace temporary function merge_session_extra(old string, new string) returns string
    return to_json(map_concat(
      map_filter(coalesce(from_json(old, '{MAP}'), cast(map() as {MAP})), (k, v) -> not coalesce(map_contains_key(from_json(new, '{MAP}'), k), false)),
      coalesce(from_json(new, '{MAP}'), cast(map() as {MAP}))))""",
    """create or replace temporary function session_expired(created timestamp, now timestamp, days int) returns boolean
    return created < now - make_dt_interval(days)""",
)


def register(spark: SparkSession) -> None:
    """merge_session_extra(old, new): flat JSON objects as one, keys of the new one win. session_expired(created, now, days).
    cleanup_old_sessions(now, days), a table of the sessions that expire and how many tasks go with each, from the views sessions and tasks."""
    for function in FUNCTIONS:
        spark.sql(function)


def register_cleanup(spark: SparkSession) -> None:
    """cleanup_old_sessions(), over the views sessions (id, created_at) and tasks (session_id), which must be there."""
    spark.sql("""create or replace temporary function cleanup_old_sessions(now timestamp, days int) returns table(id bigint, n_tasks bigint)
    return select s.id, count(t.session_id) from sessions s left join tasks t on t.session_id = s.id
           where session_expired(s.created_at, cleanup_old_sessions.now, cleanup_old_sessions.days) group by s.id""")

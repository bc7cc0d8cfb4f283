"""The job store: sessions and tasks as tables, with merge, access, search and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_PROGRESS = ("uploading", "uploaded", "queued", "tracking", "tracking_done", "analyzing")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each row: upsert by union, then the first by order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group by order, numbered in place."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("place") <= most)


def merge_updates(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """current with the columns of the one update of each key where they are not null."""
    new = updates.select(key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    joined = current.join(new, key, "left")
    return joined.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns))


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both maps; a key of the new one wins, also with a null value."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>")))


def merge_json(old: Column, new: Column) -> Column:
    """Two flat JSON objects as one; keys of the new one win."""
    kind = "map<string,string>"
    return F.to_json(merge_maps(F.from_json(old, kind), F.from_json(new, kind)))


def own_rows(sessions: DataFrame, user: str) -> DataFrame:
    return sessions.where(F.col("user_id") == user)


def own_tasks(tasks: DataFrame, sessions: DataFrame, user: str) -> DataFrame:
    """Tasks of a user's sessions."""
    return tasks.join(own_rows(sessions, user).select(F.col("id").alias("session_id")), "session_id", "left_semi")


def orphans(tasks: DataFrame, sessions: DataFrame, key: str, session_key: str) -> DataFrame:
    """Tasks whose session is gone."""
    return tasks.join(sessions.select(F.col(session_key).alias(key)), key, "left_anti")


def expired(sessions: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    return sessions.where(F.col(created) < now - F.expr(f"interval {days} days"))


def zombies(tasks: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Running tasks older than so many minutes."""
    return tasks.where((F.col("status") == "running") & (F.col("created_at") < now - F.expr(f"interval {minutes} minutes")))


def find_sessions(sessions: DataFrame, text: str | None = None, state: str | None = None) -> DataFrame:
    """Sessions whose name holds a text, whatever its case, in a state: failed, running or a status."""
    if text:
        sessions = sessions.where(F.lower("name").contains(text.lower()))
    if state == "failed":
        return sessions.where(F.col("status").endswith("_failed"))
    if state == "running":
        return sessions.where(F.col("status").isin(*IN_PROGRESS))
    return sessions.where(F.col("status") == state) if state else sessions


def flatten_extra(sessions: DataFrame, keys: list[str], extra: str = "extra") -> DataFrame:
    """Keys of the JSON in extra as columns; existing columns win."""
    named = [k for k in keys if k not in sessions.columns]
    return sessions.select("*", *(F.get_json_object(extra, f"$.{k}").alias(k) for k in named))


def only_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that df has; others are dropped without complaint."""
    return df.select(*(c for c in df.columns if c in allowed))


def missing_parts(parts: DataFrame, uploads: DataFrame, key: str) -> DataFrame:
    """Part numbers 0 to n - 1 of each upload that have not arrived."""
    wanted = uploads.select(key, F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    return wanted.join(parts.select(key, "part"), [key, "part"], "left_anti")


def busy(tasks: DataFrame, keys: list[str], states: tuple[str, ...]) -> DataFrame:
    """Keys of the tasks in one of the states."""
    return tasks.where(F.col("status").isin(*states)).select(*keys).distinct()


def truthy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are neither null nor empty."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def objects_of_sessions(objects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stored objects (name) with the session whose id is the first part of the name."""
    keyed = objects.withColumn("__id", F.split_part("name", F.lit("/"), F.lit(1)))
    return keyed.join(sessions, F.col("__id") == F.col("id").cast("string")).drop("__id")


def cleanup(sessions: DataFrame, tasks: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Sessions that expire, and the tasks that are orphans once they are gone."""
    gone = expired(sessions, "created_at", now, days)
    return gone, tasks.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_semi")

"""All queries of the tracking engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.plans import analysis, live, store, tracking, upkeep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tracking.registry.queries | store.registry.queries | analysis.registry.queries | live.registry.queries | upkeep.registry.queries


def oracle_sql() -> dict[str, str]:
    return tracking.registry.sql | store.registry.sql | analysis.registry.sql | live.registry.sql | upkeep.registry.sql

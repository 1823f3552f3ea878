"""Names of the engine's queries, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstone.plans import analysis, capture, speech

AREAS = (capture, speech, analysis)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for area in AREAS for name, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}

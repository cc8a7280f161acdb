"""The registry of core queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoscope.plans import integrity, lookup, quality, streams, upkeep


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search: three ranked legs, fused."""
    return lookup.hybrid_search(spark, d)


MODULES = (integrity, quality, lookup, upkeep, streams)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}

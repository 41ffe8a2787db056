"""The queries of the analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenspan.plans import q_chat, q_clusters, q_content, q_detection, q_features, q_relational, q_rows, q_scoring, q_segments, q_selection, q_streaming, q_sync, q_temporal

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (q_relational, q_rows, q_temporal, q_selection, q_chat, q_content, q_clusters, q_detection, q_sync, q_streaming, q_segments, q_features, q_scoring)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trending highlights."""
    return q_relational.trending(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

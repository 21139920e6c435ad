"""Registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.plans import aggregates, datasets, evaluation, graphs, imports, lifecycles, packs, scans, searches, similarities, streams, texts  # noqa: F401
from recollect.plans.base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

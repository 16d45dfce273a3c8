"""All registered queries of the library and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("scoring_queries", "pairwise_queries", "record_queries", "more_queries", "image_queries", "source_queries", "temporal_queries")


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in import_module(f"pairwright.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"pairwright.plans.{m}").ORACLES.items()}

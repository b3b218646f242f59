"""All core queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import feature_queries, learn_queries, result_queries, router_queries, router_study_queries, stat_queries, stream_queries, study_queries, text_queries  # noqa: F401
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    """The cheapest correct configuration of every sample."""
    return result_queries.cheapest_by_tier_cost(spark, directory)

"""The tables that queries start from, in Spark and in SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import last_by
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The same tables for the SQL side; common table expressions that are not used cost nothing.
WITH = """
WITH runs AS (
  SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1),
samples AS (
  SELECT * FROM bench_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC) = 1),
notes AS (
  SELECT * FROM complexity_annotations QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY annotated_at DESC, tier DESC NULLS LAST) = 1),
pairs AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY sample_id, config_id ORDER BY ingested_at DESC, result_id DESC) = 1),
matrix AS (
  SELECT p.sample_id, p.config_id, p.is_correct, p.total_cost_usd AS cost, p.result_id, c.model_name, c.provider, c.budget_level, c.budget_tokens,
    c.cost_per_1m_input AS rate, ascii(c.tier) - 64 AS tier
  FROM pairs p JOIN model_configs c USING (config_id)
  WHERE p.total_cost_usd IS NOT NULL AND NOT isnan(p.total_cost_usd) AND p.total_cost_usd >= 0)
"""


def query(sql: str | None = None, base: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            start = WITH.replace("WITH", "WITH RECURSIVE", 1) if recursive else WITH
            SQL[f.__name__] = (start if base else "") + sql
        return f

    return add


def runs(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Each run in its last delivery: ``result_id`` and the columns named, which are all that is read."""
    return last_by(table(spark, d, "eval_results"), ["result_id"], ["ingested_at"], keep)


def samples(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Each sample in its last delivery: ``sample_id`` and the columns named."""
    return last_by(table(spark, d, "bench_samples"), ["sample_id"], ["ingested_at"], keep)


def notes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """The last annotation of each sample: ``sample_id`` and the columns named."""
    return last_by(table(spark, d, "complexity_annotations"), ["sample_id"], ["annotated_at", "tier"], keep)


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample and known configuration: its last run with a known cost."""
    cost = F.col("total_cost_usd")
    wanted = ["result_id", "sample_id", "config_id", "is_correct", "total_cost_usd", "ingested_at"]
    last = last_by(table(spark, d, "eval_results"), ["result_id"], ["ingested_at"], wanted)
    pairs = last_by(last, ["sample_id", "config_id"], ["ingested_at", "result_id"]).where(cost.isNotNull() & ~F.isnan(cost) & (cost >= 0))
    configs = table(spark, d, "model_configs").select("config_id", "model_name", "provider", "budget_level", "budget_tokens", F.col("cost_per_1m_input").alias("rate"), (F.ascii("tier") - 64).alias("tier"))
    return pairs.join(configs, "config_id").select("sample_id", "config_id", "is_correct", cost.alias("cost"), "result_id", "model_name", "provider", "budget_level", "budget_tokens", "rate", "tier")

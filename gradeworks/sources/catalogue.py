"""Configuration documents as small tables: data sources with budgets, and the pool of model configurations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

POOL = "config_id string, model_key string, provider string, tier string, budget_level string, budget_tokens long, rate_input double, rate_output double, rate_reasoning double"


def _load(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading configuration documents needs pyyaml") from e
    return yaml.safe_load(Path(path).read_text()) or {}


def budgets(spark: SparkSession, path: str) -> DataFrame:
    """``(name, budget)``: every source under its key and its full name; sources without a budget are left out."""
    found = {}
    for key, entry in (_load(path).get("datasets") or {}).items():
        amount = (entry or {}).get("sample_budget")
        if amount is not None:
            found[key] = int(amount)
            if entry.get("full_name"):
                found.setdefault(entry["full_name"], int(amount))
    return spark.createDataFrame(sorted(found.items()), "name string, budget int")


def model_pool(spark: SparkSession, path: str, tier: str | None = None) -> DataFrame:
    """One row per model and budget level, without self-hosted models; ``tier`` keeps one letter."""
    rows = []
    for key, m in (_load(path).get("models") or {}).items():
        if m.get("self_hosted") or (tier and str(m.get("tier", "")).upper()[:1] != tier.upper()):
            continue
        for level, amount in (m.get("budgets") or {}).items():
            rates = [float(m.get(f"cost_per_1m_{k}") or 0.0) for k in ("input", "output", "reasoning")]
            rows.append((f"{key}_{level}", key, m.get("provider"), str(m.get("tier", "")), level, int(amount or 0), *rates))
    return spark.createDataFrame(sorted(rows), POOL)


def raw_models(path: str) -> dict[str, dict]:
    """The models of a configuration document as they are written, by key."""
    return {k: dict(m or {}) for k, m in (_load(path).get("models") or {}).items()}

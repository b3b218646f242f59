"""Every core query on empty tables and on tables with nulls in every column ends without an error."""

import importlib

import pytest
from pyspark.sql import functions as F

from gradeworks import registry
from gradeworks.sources.tables import table

MODULES = [importlib.import_module(f"gradeworks.plans.{m}") for m in ("base", "result_queries", "stat_queries", "study_queries", "text_queries", "learn_queries", "feature_queries", "router_queries", "router_study_queries")]
BATCH = sorted(n for n in registry.QUERIES if not n.startswith("stream"))


def emptied(spark, directory, name):
    return table(spark, directory, name).limit(0)


def holed(spark, directory, name):
    frame = table(spark, directory, name)
    return frame.withColumns({c: F.when(F.abs(F.xxhash64(F.monotonically_increasing_id(), F.lit(c))) % 3 == 0, F.lit(None)).otherwise(F.col(c)) for c in frame.columns})


@pytest.mark.parametrize("make", [emptied, holed])
@pytest.mark.parametrize("name", BATCH)
def test_query_survives(spark, data, monkeypatch, make, name):
    for module in MODULES:
        if hasattr(module, "table"):
            monkeypatch.setattr(module, "table", make)
    registry.QUERIES[name](spark, data).collect()

"""Extra columns in the inputs, named like what operators use inside, change nothing."""

import pytest
from pyspark.sql import functions as F

from gradeworks.llm import queries as llm_queries
from gradeworks.sources.tables import table
from tests.compare import rows_of

NAMES = ("n", "label", "axis", "score", "rank", "quota", "v", "k", "h", "u", "m", "b", "part", "error", "levels", "vals", "metric", "day", "group_id", "component", "link", "group_size", "origin", "pair_key", "response", "defect", "share", "chars", "words", "kind", "cell", "need", "available", "file", "l0", "q0", "s0", "c0", "lowest", "highest", "piece", "container", "doc_tokens", "item_id", "passage")


@pytest.mark.parametrize("name", sorted(llm_queries.QUERIES))
def test_extra_columns(spark, data, monkeypatch, name):
    plain = rows_of(llm_queries.QUERIES[name](spark, data))

    def widened(session, directory, table_name):
        frame = table(session, directory, table_name)
        return frame.withColumns({c: F.lit("x") for c in NAMES if c not in frame.columns})

    monkeypatch.setattr(llm_queries, "table", widened)
    assert rows_of(llm_queries.QUERIES[name](spark, data)) == plain

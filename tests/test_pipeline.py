"""Stages, configuration documents, clients and studies."""

import pytest
from pyspark.sql import functions as F

from gradeworks.operators import studies
from gradeworks.plans import base, pipeline
from gradeworks.sources import catalogue, clients


def test_stages_resume(spark, data, tmp_path):
    samples = base.samples(spark, data)
    stages = pipeline.sampling_stages(per_source=10, size=40)
    names = [s.name for s in stages]
    assert pipeline.run(spark, stages, f"{tmp_path}/p", {"samples": samples}) == dict.fromkeys(names, "made")
    assert pipeline.run(spark, stages, f"{tmp_path}/p", {"samples": samples}) == dict.fromkeys(names, "done")
    assert list(pipeline.run(spark, stages, f"{tmp_path}/p", {"samples": samples}, start="candidates").values()) == ["done", "done", "made", "made"]
    assert spark.read.parquet(f"{tmp_path}/p/selected").count() == 40


def test_catalogue(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "d.yaml").write_text("datasets:\n  docvqa: {full_name: DocVQA, sample_budget: 5}\n  other: {}\n")
    (tmp_path / "m.yaml").write_text("models:\n  a1: {tier: A, provider: x, budgets: {B0: 0, B1: 10}, cost_per_1m_input: 1}\n  b1: {tier: B, self_hosted: true, budgets: {B0: 0}}\n  c1: {tier: C, budgets: {B0: 0}}\n")
    assert {tuple(r) for r in catalogue.budgets(spark, f"{tmp_path}/d.yaml").collect()} == {("docvqa", 5), ("DocVQA", 5)}
    assert [r["config_id"] for r in catalogue.model_pool(spark, f"{tmp_path}/m.yaml").collect()] == ["a1_B0", "a1_B1", "c1_B0"]
    assert catalogue.model_pool(spark, f"{tmp_path}/m.yaml", "a").count() == 2


def test_clients(spark, tmp_path):
    work = spark.createDataFrame([("a", "c", "q", None), ("b", "c", "fail", None)], "sample_id string, config_id string, query string, image binary")

    def client(query, config, image):
        if query == "fail":
            raise ValueError("no")
        return query.upper(), 1, 2

    got = {r["sample_id"]: r for r in clients.call(work, client, attempts=2, pause=0.01).collect()}
    assert got["a"]["raw_answer"] == "Q" and got["a"]["error"] is None
    assert got["b"]["raw_answer"] is None and got["b"]["error"] == "ValueError: no"
    (tmp_path / "x.bin").write_bytes(b"abc")
    one = clients.images(spark, str(tmp_path)).first()
    assert (one["size"], one["md5"], one["base64"]) == (3, "900150983cd24fb0d6963f7d28e17f72", "YWJj")


def test_quotas(spark):
    def shares(counts, size):
        return {r["g"]: r["quota"] for r in studies.shares_of(spark.createDataFrame(list(counts.items()), "g string, n long"), size).collect()}

    assert shares({"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2}
    assert shares({"a": 1, "b": 99}, 10) == {"a": 1, "b": 9}
    assert shares({}, 10) == {}
    # Of 100 rows 90, 5 and 5 fall to the groups; the small ones are raised to 10, or to what they have, and the large one gives.
    rows = [(f"{g}{i}", g) for g, n in (("a", 1800), ("b", 100), ("c", 6)) for i in range(n)]
    floored = studies.floored(spark.createDataFrame(rows, "id string, g string"), "g", 100, 10, "id").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in floored} == {"a": 84, "b": 10, "c": 6}


def test_constrained_and_names(spark):
    rows = [(f"s{i}", f"t{i % 3}", f"d{i % 7}") for i in range(100)]
    frame = spark.createDataFrame(rows, "id string, t string, d string")
    got = studies.constrained(frame, [("t", 4), ("d", 3)], "id").collect()
    assert all(sum(r["t"] == t for r in got) >= 4 for t in ("t0", "t1", "t2"))
    assert all(sum(r["d"] == f"d{k}" for r in got) >= 3 for k in range(7))
    names = spark.createDataFrame([("DocVQA",), ("docvqa",), ("MP-DocVQA",), ("zzz",), (None,)], "name string")
    listed = spark.createDataFrame([("DocVQA",), ("MP-DocVQA",), ("Other",)], "entry string")
    assert {(r["name"], r["entry"]) for r in studies.matched_names(names, listed, "name", "entry").collect()} == {("DocVQA", "DocVQA"), ("docvqa", "DocVQA"), ("MP-DocVQA", "MP-DocVQA"), ("zzz", None)}


def test_probe_tier(spark):
    cases = [((True, True), 1.0, 1), ((False, False), 2.9, 3), ((False, False), 2.0, 2), ((True, False), 2.0, 2), ((True, False), 3.0, 3), ((None, None), 3.0, None), ((None, True), 3.0, 1)]
    frame = spark.createDataFrame([(*o, c) for o, c, _ in cases], "p boolean, q boolean, c double")
    assert [r["t"] for r in frame.select(studies.probe_tier([F.col("p"), F.col("q")], F.col("c")).alias("t")).collect()] == [w for *_, w in cases]

"""The training-data operators against brute force, and on nulls, ties, repeats, skew and empty tables."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeworks.llm import consensus, leakage, mixture, packing, pairs, quality, quantiles, splits, top_n
from gradeworks.llm import queries as llm_queries
from gradeworks.llm import sql as llm_sql
from gradeworks.llm.text import word_places, words
from tests.compare import rows_of, rows_of_sql

DAY = datetime.datetime(2031, 1, 1)


@pytest.mark.parametrize("name", sorted(llm_queries.QUERIES))
def test_query(spark, data, oracle, name):
    names, rows = rows_of(llm_queries.QUERIES[name](spark, data))
    assert names
    if name in llm_sql.SQL:
        assert (names, rows) == rows_of_sql(oracle, llm_sql.SQL[name])


# 1. Consensus

SCORES = "sample_id string, judge_id string, vds int, rds int, ses int, rated_at timestamp, ingested_at timestamp, extra string"


def ratings(seed=0, items=300):
    rng = random.Random(seed)
    skill = {"good1": 0.95, "good2": 0.9, "fair": 0.7, "random1": 0.25, "random2": 0.25, "few": 0.95}
    rows, truth = [], {}
    for i in range(items):
        for j, p in skill.items():
            if j == "few" and i > 8:
                continue
            scores = []
            for axis in consensus.AXES:
                t = truth.setdefault((f"s{i}", axis), rng.randint(1, 4))
                scores.append(t if rng.random() < p else rng.choice([x for x in (1, 2, 3, 4) if x != t]))
            rows.append((f"s{i}", j, *scores, DAY + datetime.timedelta(minutes=i), DAY, "x"))
    return rows, truth


def test_consensus_finds_truth_and_reliability(spark):
    rows, truth = ratings()
    frame = spark.createDataFrame(rows, SCORES)
    got = {(r["sample_id"], r["axis"]): r["label"] for r in consensus.consensus(frame).collect()}
    share = np.mean([got[k] == v for k, v in truth.items()])
    votes = {}
    for s, _, *scores in (r[:5] for r in rows):
        for axis, x in zip(consensus.AXES, scores, strict=True):
            votes.setdefault((s, axis), []).append(x)
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[k] for k, v in votes.items()])
    assert share > 0.93 and share > majority
    seen = {(r["judge_id"], r["axis"]): r["reliability"] for r in consensus.reliability(frame).collect()}
    assert seen["good1", "vds"] > 0.85 > 0.5 > seen["random1", "vds"]


def test_consensus_joins_agree_with_broadcast(spark):
    frame = spark.createDataFrame(ratings(1, 60)[0], SCORES)
    one, two = (sorted((r["sample_id"], r["axis"], r["label"], round(r["confidence"], 9)) for r in consensus.consensus(frame, broadcast_annotators=n).collect()) for n in (50_000, 1))
    assert one == two
    told = consensus.convergence(frame).first()
    assert told["converged"] and told["moved"] < 5e-3
    told = consensus.convergence(frame, rounds=1).first()
    assert not told["converged"] and told["rounds"] == 1


def test_final_ratings(spark):
    rows = [
        ("a", "j", 1, 2, 9, DAY, DAY, ""),
        ("a", "j", 4, None, 0, DAY + datetime.timedelta(1), DAY, ""),
        ("a", "j", 4, None, 0, DAY + datetime.timedelta(1), DAY, ""),
        (None, "j", 1, 1, 1, DAY, DAY, ""),
        ("a", None, 1, 1, 1, DAY, DAY, ""),
        ("b", "k", 2, 2, 2, None, None, None),
    ]
    got = consensus.final_ratings(spark.createDataFrame(rows, SCORES)).collect()
    assert {tuple(r) for r in got} == {("a", "vds", "j", 4), ("b", "vds", "k", 2), ("b", "rds", "k", 2), ("b", "ses", "k", 2)}
    empty = spark.createDataFrame([], SCORES)
    assert consensus.contested(empty).count() == 0 and consensus.reliability(empty).count() == 0


# 2. Percentiles


def test_summary_bound_and_merge():
    rng = np.random.default_rng(1)
    values = rng.lognormal(size=50_000)
    parts = np.split(values, [100, 7000, 7001, 30_000])
    whole = quantiles.Summary(256)
    for p in parts:
        s = quantiles.Summary(256)
        s.add(p)
        n, error, levels, vals = s.dump()
        whole.merge(quantiles.Summary.load(256, n, error, levels, vals))
    ordered = np.sort(values)
    assert whole.n == len(values) and whole.error < 0.05 * len(values)
    for q in (0.01, 0.5, 0.9, 0.99):
        rank = np.searchsorted(ordered, whole.quantiles([q])[0], side="right")
        assert abs(rank - q * len(values)) <= whole.error + 1


def test_summaries_are_exact_when_small_and_combine(spark):
    rng = random.Random(2)
    rows = [("c1" if rng.random() < 0.7 else None, rng.randint(0, 3), float(rng.randint(0, 50))) for _ in range(3000)] + [("c2", 1, float("nan")), ("c2", 1, -1.0), ("c2", 1, None)]
    frame = spark.createDataFrame(rows, "g string, d int, v double")
    daily = quantiles.summaries(frame, ["g", "d"], ["v"], fan_in=2)
    got = {r["g"]: r for r in quantiles.read_quantiles(quantiles.roll_up(daily, ["g"], fan_in=2), ["g"]).collect()}
    assert set(got) == {"c1", None}
    for g, r in got.items():
        own = sorted(v for k, _, v in rows if k == g)
        assert r["n"] == len(own) and r["rank_error"] == 0
        assert r["p50"] == own[int(np.ceil(0.5 * len(own))) - 1] and r["p99"] == own[int(np.ceil(0.99 * len(own))) - 1]
    assert quantiles.summaries(frame.limit(0), ["g"], ["v"]).count() == 0
    small = quantiles.read_quantiles(quantiles.summaries(frame, ["g"], ["v"], k=16, held=100), ["g"], k=16)
    assert {r["g"]: r["n"] for r in small.collect()} == {g: r["n"] for g, r in got.items()}
    assert all(r["within"] for r in quantiles.within_bounds(frame, small, ["g"], ["v"]).collect())


def test_exact_quantiles_where_summaries_have_an_error(spark):
    rng = random.Random(3)
    rows = [("c1" if i % 3 else None, float(rng.randint(0, 40)) if i % 2 else rng.lognormvariate(0, 2)) for i in range(4000)] + [("c2", 1.0)] * 500 + [("c3", 2.0), ("c3", None), ("c3", -1.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = quantiles.summaries(frame, ["g"], ["v"], k=16).cache()
    assert {r["g"] for r in found.where("error > 0").collect()} == {"c1", "c2", None}
    got = {r["g"]: r for r in quantiles.exact_quantiles(frame, found, ["g"], ["v"], k=16).collect()}
    assert set(got) == {"c1", "c2", "c3", None}
    for g, r in got.items():
        own = sorted(v for x, v in rows if x == g and v is not None and v >= 0)
        assert (r["n"], r["rank_error"]) == (len(own), 0)
        assert [r[f"p{p}"] for p in (50, 90, 95, 99)] == [own[-(-p * len(own) // 100) - 1] for p in (50, 90, 95, 99)]


def test_brackets_hold_the_value_at_the_rank():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 700, 9000):
        for values in (rng.lognormal(size=n), rng.integers(0, 5, n).astype(float), np.zeros(n)):
            s, q = quantiles.Summary(16), (0.001, 0.3, 0.5, 0.99, 1.0)
            s.add(values)
            for x, lo, hi in zip(q, *s.brackets(q), strict=True):
                assert lo < np.sort(values)[max(1, int(np.ceil(x * n - 1e-9))) - 1] <= hi


def test_daily_percentiles_are_those_of_sql_over_large_days(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    rows = [(i, "s", "c" if i % 5 else "e", True, rng.randint(1, 10**6), rng.random(), DAY + datetime.timedelta(days=i % 5 % 2) if i % 7 else None, DAY) for i in range(60_000)]
    rows += [(0, "s", "late", True, 5, 0.5, DAY, DAY + datetime.timedelta(days=1))]
    spark.createDataFrame(rows, "result_id long, sample_id string, config_id string, is_correct boolean, latency_ms long, total_cost_usd double, observed_at timestamp, ingested_at timestamp").repartition(4).write.parquet(f"{tmp_path}/eval_results.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW eval_results AS SELECT * FROM '{tmp_path}/eval_results.parquet/*.parquet'")
    assert rows_of(llm_queries.p2_daily_percentiles(spark, str(tmp_path))) == rows_of_sql(con, llm_sql.SQL["p2_daily_percentiles"])


# 3. Splits


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("data/images/Box/IMG 1_p03.png", "x", "box/img 1"),
        ("data\\images\\box\\img%201-page-3.tif?v=2", "x", "box/img 1"),
        ("./data//images/../images/box/img 1.pdf#page=9", None, "box/img 1"),
        ("/mnt/a/box/img 1_pg0004.jpeg", "x", "box/img 1"),
        ("img 1.p2.jpg", "x", "pool/img 1"),
        ("img 1.p2.jpg", None, None),
        ("data/images/missing.png", "x", None),
        ("n/a", "x", None),
        (" ", "x", None),
        (None, "x", None),
        ("box/100%.png", "x", "box/100%"),
    ],
)
def test_document_key(spark, path, source, want):
    frame = spark.createDataFrame([(path, None if source is None else "pool")], "p string, c string")
    assert frame.select(splits.document_key(F.col("p"), F.col("c")).alias("k")).first()["k"] == want


def test_variant_key(spark):
    same = ["docvqa_val_00000012", "DOCVQA_val_12", "docvqa-validation-00000012", "docvqa_val_00000012_v2", "docvqa_val_00000012-r1", "docvqa_val_00000012b", "docvqa_val_00000012_t4"]
    frame = spark.createDataFrame([(s,) for s in [*same, "docvqa_test_12", "odd", None]], "s string")
    keys = [r["k"] for r in frame.select(splits.variant_key(F.col("s")).alias("k")).collect()]
    assert set(keys[: len(same)]) == {"docvqa/val/12"} and keys[len(same) :] == ["docvqa/test/12", None, None]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 200):03d}", f"l{rng.randint(0, 120)}") for _ in range(240)] + [(f"c{i:03d}", f"chain{i + k}") for i in range(60) for k in (0, 1)] + [(f"h{i:03d}", "hot") for i in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, link in edges:
        parent[find(n)] = find(("l", link))
    groups = {}
    for n, _ in edges:
        groups.setdefault(find(n), set()).add(n)
    want = {n: min(g) for g in groups.values() for n in g}
    for plain in (1_000_000, 0):
        got = splits.connected_components(spark.createDataFrame(edges, "node string, link string"), "node", "link", plain=plain)
        assert {r["node"]: r["component"] for r in got.collect()} == want
    assert splits.connected_components(spark.createDataFrame([], "node string, link string"), "node", "link").count() == 0


def test_splits_keep_groups_and_sizes(spark):
    rng = random.Random(4)
    rows = [(f"s{i}", rng.choice(["T1", "t1 ", "T2", None]), f"g{rng.randint(0, 600)}" if i > 900 else "hot") for i in range(3000)]
    samples = spark.createDataFrame([(s, t) for s, t, _ in rows], "sample_id string, task_type string")
    groups = spark.createDataFrame([(s, g) for s, _, g in rows], "sample_id string, group_id string")
    got = splits.stratified_splits(samples, groups, block_groups=200, plain=0).collect()
    where = {}
    for r in got:
        where.setdefault(r["group_id"], set()).add(r["split"])
    assert len(got) == 3000 and all(len(v) == 1 for v in where.values())
    sizes = {s: sum(r["split"] == s for r in got) / 3000 for s in ("train", "validation", "test")}
    assert abs(sizes["train"] - 0.8) < 0.03 and abs(sizes["validation"] - 0.1) < 0.03 and abs(sizes["test"] - 0.1) < 0.03


def test_splits_of_rare_labels(spark):
    """A label of 400 rows among 40,000, dealt over many blocks, keeps the proportions."""
    rows = spark.range(40_400).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") < 400, "RARE").when(F.col("id") % 97 == 0, F.concat(F.lit("L"), F.col("id") % 70)).otherwise("T1").alias("task_type"))
    groups = rows.select("sample_id", F.col("sample_id").alias("group_id"))
    got = splits.stratified_splits(rows, groups, block_groups=500).join(rows, "sample_id").where("task_type = 'RARE'").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 320, "validation": 40, "test": 40}


# 4. Top N


def test_top_n_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "é"]), float(rng.randint(0, 40)), rng.randint(0, 5), i) for i in range(6000)] + [("one", 1.0, 1, 1)] * 2
    frame = spark.createDataFrame(rows, "g string, score double, t int, id int")
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r[1:])
    got = {}
    for r in top_n.top_n(frame.withColumn("extra", F.lit(1)), "g", ["score", "t", "id"], 3, bucket_rows=500, row_group_bytes=1024).collect():
        got.setdefault(r["g"], []).append((r["score"], r["t"], r["id"]))
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:3] for g, v in want.items()}
    assert top_n.top_n(frame.limit(0), "g", ["score", "id"], 3).count() == 0


def test_row_groups_are_skipped(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"g": ["a"] * 1000 + ["b"] * 2, "score": [float(i // 10) for i in range(1000)] + [0.0, 1.0], "id": list(range(1002))})
    pq.write_table(table, tmp_path / "x.parquet", row_group_size=100)
    stats = {}
    got = top_n.read_top(open(tmp_path / "x.parquet", "rb"), "g", ["score", "id"], 3, stats).to_pylist()
    assert [r["id"] for r in got if r["g"] == "a"] == [0, 1, 2] and len(got) == 5
    assert stats["skipped"] >= 8
    # Row groups that hold several groups: by score all 40 groups come first, later row groups are skipped.
    mixed = sorted((float(i // 40), f"g{i % 40:02d}", i) for i in range(2000))
    pq.write_table(pa.table({"g": [r[1] for r in mixed], "score": [r[0] for r in mixed], "id": [r[2] for r in mixed]}), tmp_path / "y.parquet", row_group_size=200)
    stats = {}
    got = top_n.read_top(open(tmp_path / "y.parquet", "rb"), "g", ["score", "id"], 3, stats).to_pylist()
    assert len(got) == 120 and {r["score"] for r in got} == {0.0, 1.0, 2.0} and stats == {"read": 1, "skipped": 9}


def test_top_n_where_only_spark_opens_files(spark, monkeypatch):
    frame = spark.createDataFrame([("hot", float(i % 700), i) for i in range(3000)] + [("a", 1.0, 1), (None, 2.0, 2)], "g string, score double, id int")
    want = sorted(map(str, top_n.top_n(frame, "g", ["score", "id"], 3, bucket_rows=500, row_group_bytes=1024).collect()))
    told = top_n.skipping(frame, "g", ["score", "id"], 3, bucket_rows=500, row_group_bytes=1024).collect()
    assert sum(r["row_groups_read"] for r in told) > 0

    def closed(uri):
        raise OSError(uri)

    monkeypatch.setattr(top_n, "_open", closed)
    assert sorted(map(str, top_n.top_n(frame, "g", ["score", "id"], 3, bucket_rows=500, row_group_bytes=1024).collect())) == want


# 5. Mixture


def test_smallest_keys_and_quotas(spark):
    rows = [(f"s{i}", "hot" if i % 3 else "rare", 1 + i % 3) for i in range(900)]
    frame = spark.createDataFrame(rows, "sample_id string, c string, tier int")
    quota = spark.createDataFrame([("hot", 50), ("rare", 0), ("none", 7)], "c string, quota long")
    got = {r["sample_id"] for r in mixture.smallest_keys(frame, ["c"], quota, "sample_id", cell_rows=20).collect()}
    keyed = sorted((r["k"], r["sample_id"]) for r in frame.where("c = 'hot'").select("sample_id", mixture.random_key(F.col("sample_id"), 42).alias("k")).collect())
    assert got == {s for _, s in keyed[:50]}
    demand = spark.createDataFrame([("T1", "a", 1, 6000, 2, 60, 100), ("T1", "b", 1, 3900, 2, 39, 10), ("T1", "c", 1, 100, 5, 5, 50), ("T1", "d", 1, 0, 0, 0, 9)], "task_type string, source_dataset string, tier int, target_bp int, min_rows int, need long, available long")
    dealt = {r["source_dataset"]: r["quota"] for r in mixture.quotas(demand, 100).collect()}
    assert sum(dealt.values()) == 100 and dealt["b"] == 10 and dealt["c"] >= 5 and dealt["d"] == 0


def test_floors_beyond_the_draw(spark):
    """Ten categories with a floor of 30 and a draw of 100: no more than 100 are drawn, all short ones told."""
    demand = spark.createDataFrame([("T1", f"s{i}", 1, 1000, 30, 30, 50 + i) for i in range(10)], "task_type string, source_dataset string, tier int, target_bp int, min_rows int, need long, available long")
    dealt = [r["quota"] for r in mixture.quotas(demand, 100).collect()]
    assert sum(dealt) == 100 and set(dealt) == {10}
    samples = spark.createDataFrame([(f"x{i}", "T1", f"s{i % 10}", DAY) for i in range(500)], "sample_id string, task_type string, source_dataset string, ingested_at timestamp")
    notes = spark.createDataFrame([(f"x{i}", 1, DAY) for i in range(500)], "sample_id string, tier int, annotated_at timestamp")
    told = mixture.report(samples, notes, demand.select("task_type", "source_dataset", "tier", "target_bp", "min_rows")).collect()
    assert all((r["need"], r["quota"], r["short_by"], r["reason"]) == (30, 10, 20, "draw") for r in told) and len(told) == 10
    assert mixture.draw_sample(samples, notes, demand.select("task_type", "source_dataset", "tier", "target_bp", "min_rows")).count() == 100


# 6. Pairs


@pytest.fixture(scope="module")
def tester():
    rng = random.Random(6)
    fields = ("unit price", "due date", "page count")
    texts = [f"The {rng.choice(fields)} shown on the page is {rng.randint(1, 9999)}." for _ in range(400)] + [f"The answer is {rng.randint(1, 999)}" for _ in range(300)] + ["letter", "memo"] * 40
    words = {"en": ("the shown on page is answer what which price date count unit due of printed give read and report " * 30).split(), "de": ("der die das auf dem dokument steht welche angabe zeigt blatt in letzten zeile wert " * 30).split()}
    for lang, listed in pairs.LEXICON.items():
        words.setdefault(lang, []).extend(listed.split() * 3)
    answered = Counter(g for t in texts for g in pairs.refusal_features(t))
    declined = [f"{a} {b} the {c}." for a in ("I cannot", "I'm sorry, but I cannot", "I am unable to") for b in ("read", "see", "describe") for c in ("image", "page", "table", "form")]
    refused = Counter(g for t in declined for g in pairs.refusal_features(t))
    refusals = pairs.RefusalModel.of(refused, answered, len(declined), len(texts), pairs.example_features())
    return pairs.Tester(pairs.EndModel(texts), pairs.LanguageModel(words), refusals)


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("What is the unit price shown on the page?", None, "empty"),
        ("What is the unit price shown on the page?", '{"answer": ""}', "empty"),
        ("What is the unit price shown on the page?", "**Answer:** ", "empty"),
        ("What is the unit price shown on the page?", "​", "empty"),
        ("What is the unit price shown on the page?", "I'm sorry, but I cannot read the image.", "refusal"),
        ("What is the unit price shown on the page?", "what is the unit price shown on the page", "copy"),
        ("What is the unit price shown on the page?", "The unit price shown on the page is 53.", None),
        ("What is the unit price shown on the page?", "The unit price shown on the", "truncated"),
        ("What is the unit price shown on the page?", "The unit price shown on the pa", "truncated"),
        ("What is the unit price shown on the page?", '{"answer": "The unit price shown', "truncated"),
        ("What is the unit price shown on the page?", "The answer is 53", None),
        ("What is the unit price shown on the page?", "Wartość podana na tej stronie to 53.", "language"),
        ("What is the unit price shown on the page?", "Auf dem Dokument steht in der letzten Zeile der Wert 5.", "language"),
        ("What does the notice beside the page say?", "Nur für den internen Gebrauch", None),
        ("What does the notice beside the page say?", "We are unable to accept cash", None),
        ("What does the notice beside the page say?", "I cannot read the notice.", "refusal"),
        ("What is the unit price shown on the page?", "Nie mogę odpowiedzieć na to pytanie, bo obraz jest zbyt ciemny.", "refusal"),
        ("What is the unit price shown on the page?", "Üzgünüm, bu soruyu yanıtlayamam.", "refusal"),
        ("What is the unit price shown on the page?", "我无法回答这个问题", "refusal"),
        ("What is the unit price shown on the page?", "Jag kan inte svara på frågan.", "refusal"),
        (None, "memo", None),
        ("", "", "empty"),
    ],
)
def test_defects(tester, query, text, want):
    page = "We are unable to accept cash" if text and "cash" in text else "Nur für den internen Gebrauch"
    assert tester.defect(query, text, page)[0] == want


def test_broken_pairs_on_nulls_and_empty_tables(spark):
    samples = spark.createDataFrame([("a", "What is it?", None, DAY), ("b", None, "x", DAY), (None, "q", "x", DAY)], "sample_id string, query string, gt_answer string, ingested_at timestamp")
    results = spark.createDataFrame([(1, "a", "", "observed", DAY), (2, "zz", "", "observed", DAY), (3, "a", None, "inferred", DAY), (1, "a", "5", "observed", DAY - datetime.timedelta(1))], "result_id long, sample_id string, predicted_answer string, result_type string, ingested_at timestamp").withColumn("is_correct", F.lit(None).cast("boolean"))
    documents = spark.createDataFrame([(1, None, "en"), (2, "the page is the page", " EN")], "doc_id long, text string, lang string")
    got = {tuple(r) for r in pairs.broken_pairs(samples, results, documents).collect()}
    assert got == {("gold", "a", "empty"), ("run", "1", "empty")}
    assert pairs.broken_pairs(samples.limit(0), results.limit(0), documents.limit(0)).count() == 0


def test_page_texts_are_no_cases_however_many(spark):
    """Every page text excuses what quotes it: 3,000 of them, each the gold of two quotation queries."""
    ids = spark.range(6000)
    pages = F.concat(F.lit("We cannot accept bill number "), F.floor(F.col("id") / 2), F.lit(" und das ist nicht mein Problem"))
    samples = ids.select(F.concat(F.lit("s"), "id").alias("sample_id"), F.lit("What is written in the box exactly as printed?").alias("query"), pages.alias("gt_answer"), F.lit(DAY).alias("ingested_at"))
    results = ids.select(F.col("id").alias("result_id"), F.concat(F.lit("s"), (F.col("id") + 2) % 6000).alias("sample_id"), pages.alias("predicted_answer"), F.lit("observed").alias("result_type"), F.lit(DAY).alias("ingested_at"), F.lit(True).alias("is_correct"))
    documents = spark.createDataFrame([(2, "the page is the page", "en")], "doc_id long, text string, lang string")
    refused = spark.createDataFrame([(9000, "s1", "I cannot answer that.", "observed", DAY, False)], results.schema)
    assert [tuple(r) for r in pairs.broken_pairs(samples, results.unionByName(refused), documents).collect()] == [("run", "9000", "refusal")]


def test_end_model_counts_every_response(spark):
    """21 of 200,000 responses have this context: a sample of them would not know it."""
    rare = F.when(F.col("id") < 20, "see the zorp marked below now").when(F.col("id") == 20, "see the zorp").otherwise("The answer is 5.")
    results = spark.range(200_000).select(F.col("id").alias("result_id"), F.lit("a").alias("sample_id"), rare.alias("predicted_answer"), F.lit("observed").alias("result_type"), F.lit(DAY).alias("ingested_at"), F.lit(True).alias("is_correct"))
    samples = spark.createDataFrame([("a", "What is it?", "5", DAY)], "sample_id string, query string, gt_answer string, ingested_at timestamp")
    documents = spark.createDataFrame([(2, "the page is the page", "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in pairs.broken_pairs(samples, results, documents).collect()] == [("run", "20", "truncated")]
    texts = spark.createDataFrame([("The sum is 5.",), ("The sum is",), ("The sum is 5.",), (None,)] * 9, "t string")
    whole, counted = pairs.EndModel([r["t"] for r in texts.collect() if r["t"]]), pairs.fit_ends(texts, "t")
    assert counted.__dict__ == whole.__dict__


# 7. Packing


def test_first_fit_decreasing_against_brute_force():
    rng = random.Random(7)
    for _ in range(20):
        sizes = sorted((rng.randint(0, 100) for _ in range(rng.randint(0, 60))), reverse=True)
        space, want = [], []
        for s in sizes:
            k = next((i for i, x in enumerate(space) if x >= s), None)
            if k is None:
                space.append(100)
                k = len(space) - 1
            want.append(k)
            space[k] -= s
        assert packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)[0].tolist() == want


def test_packing_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randint(0, 90)) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 1000), (None, "abc")]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=100, group_docs=80)
    got = placed.collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        size = len((t or "").encode())
        assert sum(r["tokens"] for r in by[i]) == size
        assert len(by[i]) == max(1, -(-size // 100))
    used = {}
    for r in got:
        used.setdefault(r["container"], []).append((r["offset"], r["offset"] + r["tokens"]))
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {r["doc_id"] for r in packing.split_documents(placed).collect()} == {i for i, t in rows if len((t or "").encode()) > 100}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 8. Leakage


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(100)]
    other = [rng.choice(vocabulary) for _ in range(100)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    slipped = [w[:-1] + "x" if i % 12 == 5 else w for i, w in enumerate(passage)]
    frame_like = [w if i % 5 else rng.choice(vocabulary) for i, w in enumerate(passage)]
    docs = {
        1: " ".join(noise(50) + passage[20:75] + noise(50)),
        2: " ".join(noise(30) + passage[:30] + noise(30)),
        3: " ".join(slipped).upper().replace(" ", ", "),
        4: " ".join(frame_like),
        5: "<p>" + "</p> <b>".join(" ".join(passage[i : i + 10]) for i in range(0, 100, 10)) + "</b>",
        6: " ".join(noise(500)),
        7: None,
        8: "",
        9: " ".join(passage + noise(5) + other),
    }
    items = [(10, " ".join(passage)), (11, " ".join(other)), (12, None), (13, "two words")]
    got = leakage.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 10), (3, 10), (5, 10), (9, 10), (9, 11)}
    documents = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, passage string")
    for clean in (leakage.remove_spans(documents.withColumn("extra", F.lit(1)), got).select("doc_id", "text"), leakage.clean(documents, held), leakage.clean(documents, held, block_words=120)):
        cleaned = {r["doc_id"]: r["text"] for r in clean.collect()}
        assert cleaned[6] == docs[6] and cleaned[7] is None and len(cleaned) == 9
        assert cleaned[1].split()[:50] == docs[1].split()[:50] and len(cleaned[1].split()) <= 101
        assert leakage.find_leaks(clean, held).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.find_leaks(empty, spark.createDataFrame(items, "item_id long, passage string")).count() == 0
    assert leakage.find_leaks(documents, spark.createDataFrame([], "item_id long, passage string")).count() == 0


def test_every_stretch_is_found_and_cut(spark):
    rng = random.Random(11)
    passage = [f"p{i}q" for i in range(80)]
    noise = [f"n{rng.randint(0, 999)}z" for _ in range(60)]
    twice = " ".join([*noise[:20], *passage, *noise[20:40], *passage, *noise[40:]])
    documents = spark.createDataFrame([(1, twice.replace("n", "N")), (1, twice.replace("n", "N"))], "doc_id long, text string")
    held = spark.createDataFrame([(5, " ".join(passage)), (6, " ".join(passage[30:] + [f"x{i}y" for i in range(20)]))], "item_id long, passage string")
    found = leakage.find_leaks(documents, held)
    spans = sorted((r["item_id"], r["first_word"], r["last_word"]) for r in found.collect())
    assert spans == [(5, 20, 99), (5, 120, 199), (6, 50, 99), (6, 150, 199)]
    in_blocks = leakage.find_leaks(documents, held, block_words=60)
    assert sorted((r["item_id"], r["first_word"], r["last_word"]) for r in in_blocks.collect()) == spans
    for clean in (leakage.clean(documents, held), leakage.remove_spans(documents, found), leakage.remove_spans(documents, found, most=0)):
        assert [r["text"].split() for r in clean.collect()] == [" ".join(noise).replace("n", "N").split()] * 2
    words = [f"w{i}" for i in range(30)]
    assert leakage.cut_words(" ".join(words), [(10, 20), (5, 15)]).split() == words[:5] + words[21:]


@pytest.mark.parametrize("seed", range(3))
def test_word_places(seed):
    rng = random.Random(seed)
    parts = ["Hello", "wor-\n ld", "it’s", "3,000.5", "<b>x</b>", "[link](http://ab)", "&amp;", "&eacute;t", "é", "e\u0301", "ﬁne", "\u200b", "\xad", "İx", "ΑΣ", "한국", "\u1112\u1161", "日本", "—", "½", "&", "<", "a_b"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(" \n") for _ in range(rng.randint(0, 9)))
        places = word_places(text)
        assert len(places) == len(words(text))
        for word, (a, b) in zip(words(text), places, strict=True):
            assert word in words(text[a:b]) or "<" in text or "_" in text[a:b] or "-" in text[a:b] or "[" in text


# 9. Quality

PROSE = "The committee had read the report, and it was not clear to them which of the figures were right. "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (PROSE * 5, None),
        (PROSE.upper() * 4, None),
        ("When the new form arrived in\nWest Ostnolund, Kelmere\nHolding had not\nyet counted the\nold paper items.", None),
        ("> " + PROSE + "\n> " + PROSE, None),
        ("Q: " + PROSE + "\nA: " + PROSE, None),
        ("Der Bericht nennt einen Wert, aber die Zeichnung zeigt, dass er nicht mit der Tabelle stimmt. " * 4, None),
        ("この表の最後の列は紙が折れているため読み取れませんでした。" * 5, None),
        ("\n".join(f"- item {i} blue" for i in range(20)), "list"),
        ("\n".join(f"Field {i}: {i * 7}" for i in range(20)), "list"),
        ("\n".join(f"{i}. red box" for i in range(1, 20)), "list"),
        ("\n".join(f"| a{i} | {i} | x |" for i in range(20)), "table"),
        ("\n".join(f"a{i},{i},x,{i * 3}" for i in range(20)), "table"),
        ("\n".join(f"a{i}\t{i}\tx" for i in range(20)), "table"),
        ("\n".join(f"name{i}          {i}          value" for i in range(20)), "table"),
        ("<table>" + "".join(f"\n<tr><td>{i}</td><td>x</td></tr>" for i in range(20)) + "</table>", "table"),
        ("page page page page wide " * 20, "junk"),
        ("4e30298b 72c3283a 95f741e754202309802e50588d2e39bc " * 10, "junk"),
        ("qdqqbjcb smvvbyx vwczrjsmsxpqg cctl njzlzvk " * 10, "junk"),
        ("=====\n*****\n-----\n" * 10, "junk"),
        (None, None),
        ("  \n ", None),
        ("", None),
    ],
)
def test_kinds(spark, text, want):
    got = quality.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["kind"] == want


def test_chunks_add_up(spark):
    rng = random.Random(10)
    texts = [PROSE * rng.randint(1, 80) + "\n" + "\n".join(f"- item {i}" for i in range(rng.randint(0, 200))) for _ in range(6)] + ["x" * 9000, "a b " * 3000, PROSE * 90, ("the value of it is, " * 130 + "\n- item\nand so") * 9, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r.asDict() for r in quality.counts(frame, 1 << 20).collect()}
    cut = {r["doc_id"]: r.asDict() for r in quality.counts(frame, 4096).collect()}
    for i, t in enumerate(texts):
        for c in quality.COUNTS:
            assert whole[i][c] == cut[i][c], (i, c)
        if t:
            assert "".join(c[0] for c in quality.chunks(t, 4096)) == t
    assert quality.statistics(frame.limit(0)).count() == 0

"""Operators against brute force, and on nulls, ties, repeats and empty tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gradeworks.functions import features, stats, text
from gradeworks.operators import learn, results, routing, sampling, similarity, statistics

MATRIX = "sample_id string, config_id string, tier int, cost double, is_correct boolean"


def matrix_of(seed, n=40):
    rng = random.Random(seed)
    return [(f"s{i}", f"c{j}", 1 + j % 3, float(rng.randint(1, 5)), rng.choice([True, False, None])) for i in range(n) for j in range(6) if rng.random() < 0.8]


def test_cheapest_and_cascade(spark):
    rows = matrix_of(1)
    frame = spark.createDataFrame(rows, MATRIX)
    want = {}
    for s, c, t, cost, ok in rows:
        want.setdefault(s, [])
        if ok:
            want[s].append((t, cost, c))
    got = {r["sample_id"]: r["config_id"] for r in routing.cheapest(frame, ["tier", "cost"]).collect()}
    assert got == {s: min(v)[2] if v else None for s, v in want.items()}
    assert {r["sample_id"]: r["config_id"] for r in routing.cascade(frame).collect()} == got


def test_violations(spark):
    rows = matrix_of(2)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {}
    for s, own in by.items():
        pairs = [(a, b) for a, b in itertools.permutations(own, 2) if a[2] < b[2] and a[4]]
        want[s] = (len(pairs), sum(not b[4] for _, b in pairs))
    got = {r["sample_id"]: (r["pairs"], r["violated"]) for r in routing.violations(spark.createDataFrame(rows, MATRIX)).collect()}
    assert got == want


def test_strict_frontier(spark):
    rng = random.Random(3)
    points = [(f"c{i}", float(rng.randint(1, 6)), float(rng.randint(1, 6))) for i in range(30)]
    want = {p[0] for p in points if not any(q[1] < p[1] and q[2] > p[2] for q in points)}
    got = routing.strict_frontier(spark.createDataFrame(points, "config_id string, cost double, accuracy double"))
    assert {r["config_id"] for r in got.collect()} == want


def test_empty_tables(spark):
    frame = spark.createDataFrame([], MATRIX)
    assert routing.cheapest(frame, ["tier"]).count() == 0
    assert routing.violations(frame).count() == 0
    assert routing.spent_until_right(frame).count() == 0
    assert results.last_by(frame, ["sample_id"], ["cost"]).count() == 0
    assert sampling.per_group(frame, "sample_id", 2, "config_id").count() == 0


def test_last_and_first(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 2, "y"), (None, 1, "z"), ("b", None, "q")]
    frame = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in results.last_by(frame, ["k"], ["o"]).collect()} == {("a", "y"), (None, "z"), ("b", "q")}
    assert {(r["k"], r["v"]) for r in results.first_by(frame, ["k"], ["o"]).collect()} == {("a", None), (None, "z"), ("b", "q")}


def test_merge_signals_and_pending(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 9, True)], "k string, o int, v boolean")
    new = spark.createDataFrame([("a", 0, False)], "k string, o int, v boolean")
    assert {(r["k"], r["v"]) for r in results.merge_last(old, new, ["k"], ["o"]).collect()} == {("a", False), ("b", True)}
    got = results.first_signal([("new", new.withColumn("v", F.lit(None).cast("boolean")), "v"), ("old", old, "v")], ["k"], F.lit(False))
    assert {(r["k"], r["value"], r["signal"]) for r in got.collect()} == {("a", True, "old"), ("b", True, "old")}
    samples = spark.createDataFrame([("a",), ("b",), ("a",)], "sample_id string")
    configs = spark.createDataFrame([("x",), ("y",)], "config_id string")
    done = spark.createDataFrame([("a", "x")], "sample_id string, config_id string")
    assert {tuple(r) for r in results.pending(samples, configs, done).collect()} == {("a", "y"), ("b", "x"), ("b", "y")}


def test_dedup(spark):
    rows = [("r1", "What is X?", "low"), ("r2", "what is  x", "high"), ("r3", "other", "low"), ("r4", None, "low")]
    frame = spark.createDataFrame(rows, "id string, q string, src string")
    rank = F.when(F.col("src") == "high", 1).otherwise(0)
    got = {r["id"]: r["n_rows"] for r in results.priority_dedup(frame, [text.text_key(F.col("q"))], rank, ["id"], "id").collect()}
    assert got == {"r2": 2, "r3": 1, "r4": 1}


def test_extraction(spark):
    cases = {
        "<think>hm</think>The answer is: 42": "42",
        '{"answer": "7 May"}': "7 May",
        "**Paris**": "Paris",
        "Yes, because it says so.": "Yes",
        "\n\n first line\nsecond": "first line",
        None: "",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r["a"] for r in frame.select(text.extract_answer(F.col("t")).alias("a")).collect()] == list(cases.values())
    one = spark.createDataFrame([("ANSWER: 5\nTYPE: Form\nELEMENTS: table, none, Chart\nVISUAL: layout | text\nREASONING: odd",)], "t string").select(text.structured_response(F.col("t")).alias("s")).first()["s"]
    assert (one["answer"], one["doc_type"], one["elements"], one["vds"], one["rds"], one["ses"]) == ("5", "form", ["table", "chart"], 2, 2, 2)
    leaves = spark.createDataFrame([('{"a": {"b": "1", "c": ""}, "d": "2"}',)], "t string").select(text.json_leaves(F.col("t")).alias("m")).first()["m"]
    assert leaves == {"a.b": "1", "d": "2"}


def test_hash_distance(spark):
    rows = [("0", "0"), ("1", "0"), ("zz", "0"), ("ffffffffffffffff", "0"), (None, "0")]
    got = spark.createDataFrame(rows, "a string, b string").select(text.hex_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [0, 1, 999, 64, 999]


def test_near_hashes(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    values = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(set(values), 2) if (a ^ b).bit_count() <= 3}
    got = similarity.near_hashes(spark.createDataFrame(list(enumerate(values)), "id long, h long"), "id", "h", 3)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_neighbours(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(99, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)

    got = {}
    for r in similarity.neighbours(frame.where("id < 5"), frame, "id", "v", 3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["neighbour_id"]
    for q in range(5):
        best = sorted((-round(cosine(rows[q][1], v), 9), i) for i, v in rows[:40] if i != q)[:3]
        assert [got[q][k] for k in (1, 2, 3)] == [i for _, i in best]


def test_statistics(spark):
    rng = random.Random(6)
    rows = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 9)), rng.random() < 0.4) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, y boolean")

    def ranks(x):
        return [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]

    ra, rb = ranks([r[1] for r in rows]), ranks([r[2] for r in rows])
    ma, mb = sum(ra) / 200, sum(rb) / 200
    cov = sum((x - ma) * (y - mb) for x, y in zip(ra, rb, strict=True))
    rho = cov / (sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb)) ** 0.5
    assert statistics.spearman(frame, "a", "b").first()["rho"] == pytest.approx(rho, abs=2e-6)
    pos, neg = [r[1] for r in rows if r[3]], [r[1] for r in rows if not r[3]]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert statistics.auc(frame, "a", F.col("y")).first()["auc"] == pytest.approx(auc, abs=2e-6)
    ks = max(abs(sum(p <= x for p in pos) / len(pos) - sum(q <= x for q in neg) / len(neg)) for x in {r[1] for r in rows})
    assert statistics.ks_statistic(frame, "a", F.col("y")).first()["ks"] == pytest.approx(ks, abs=2e-6)


def test_wilson_and_bayes(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    one = spark.range(1).select(low.alias("l"), high.alias("h"), stats.bayes(F.array(F.lit(0.5), F.lit(0.5)), [F.array(F.lit(0.0), F.lit(0.0))]).alias("p"), stats.all_right_bound(F.lit(0)).alias("z")).first()
    assert (one["l"], one["h"], one["p"], one["z"]) == (0.0, 1.0, [0.5, 0.5], 0.0)


def test_soft_tiers(spark):
    frame = spark.createDataFrame([(t, s / 20) for t in (1, 2, 3) for s in range(20, 80)], "t int, s double")
    for row in frame.select(features.soft_tiers(F.col("t"), F.col("s")).alias("p"), "t").collect():
        assert sum(row["p"]) == pytest.approx(1.0, abs=1e-9)
        assert max(row["p"]) == row["p"][row["t"] - 1]


def test_sampling_sizes(spark):
    rows = [(f"s{i}", 1 + (i % 7 > 2) + (i % 7 > 4), f"g{i % 3}") for i in range(500)]
    frame = spark.createDataFrame(rows, "id string, tier int, grp string")
    assert sampling.proportional(frame, "tier", 100, ["id"]).count() == 100
    assert sampling.proportional(frame, "tier", 10_000, ["id"]).count() == 500
    assert sampling.weighted_tiers(frame, "tier", 90, {1: 0.3, 2: 0.4, 3: 0.3}, "id").count() == 90
    assert sampling.per_group(frame, "grp", 7, "id").count() == 21
    picked = sampling.diverse(frame.withColumn("p", F.lit(1.0)), "grp", ["tier", "grp"], "p", "id", 5).collect()
    assert len(picked) == 15 and len({r["id"] for r in picked}) == 15


def test_thresholds(spark):
    rows = [(i / 100, i < 30, 30 <= i < 60, i >= 60) for i in range(100)]
    best = learn.best_thresholds(spark.createDataFrame(rows, "s double, a boolean, b boolean, c boolean"), "s", ["a", "b", "c"], steps=99).first()
    assert best["accuracy"] > 0.97


def test_region_and_vectors(spark):
    one = spark.range(1).select(features.region(F.lit(0.5), F.lit(0.1)).alias("r"), features.outer_product(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("o"), features.tuple_distance(F.array(F.lit("a"), F.lit(None)), F.array(F.lit("b"), F.lit(None))).alias("d")).first()
    assert (one["r"], one["o"], one["d"]) == ("top", [3.0, 4.0, 6.0, 8.0], 1)


def test_facility_location_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.randint(0, 3) / 2, rng.randint(0, 3) / 2]) for i in range(40)]
    got = sampling.facility_location(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", 6, 0.7).orderBy("pick").collect()
    first = {}
    for i, v in rows:
        first.setdefault(tuple(v), i)

    def near(a, b):
        return math.exp(-sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / (2 * 0.7 * 0.7))

    covered, want = [0.0] * len(rows), []
    for _ in range(6):
        gain = {i: round(sum(max(0, near(v, w) - c) for (_, w), c in zip(rows, covered, strict=True)), 9) for v, i in first.items() if i not in want}
        best = min(gain, key=lambda i: (-gain[i], i))
        want.append(best)
        covered = [max(c, near(rows[best][1], w)) for (_, w), c in zip(rows, covered, strict=True)]
    assert [r["id"] for r in got] == want


def test_ranks_of_large_groups(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randint(0, 50), i) for i in range(900)]
    got = sampling.ranked_in_groups(spark.createDataFrame(rows, "g string, o int, id long"), ["g"], [F.col("o"), F.col("id")]).collect()
    groups = {}
    for g, o, i in rows:
        groups.setdefault(g, []).append((o, i))
    assert len(got) == 900
    for r in got:
        own = sorted(groups[r["g"]])
        assert own[r["__rank"] - 1] == (r["o"], r["id"]) and r["__rank_of"] == len(own)
    kept = sampling.keep_within(spark.createDataFrame([(i, 1.0 if i != 5 else None) for i in range(100)], "id long, c double"), 20.0, "c", ["id"]).collect()
    assert sorted(r["id"] for r in kept) == list(range(20))


def test_near_members(spark):
    """Links at distances 4 to 8 count, and classes go over chains of them."""
    rng = random.Random(8)
    values = [rng.getrandbits(63) for _ in range(25)]
    for step in (4, 6, 8):
        for v in values[:15]:
            for bit in rng.sample(range(63), step):
                v ^= 1 << bit
            values.append(v)
    values += values[:5]
    whole = sorted(set(values))
    linked = {v: [u for u in whole if u != v and (u ^ v).bit_count() <= 8] for v in whole}
    kind = {}
    for v in whole:
        todo = [v]
        while todo:
            u = todo.pop()
            if u not in kind:
                kind[u] = v
                todo += linked[u]
    got = similarity.near_members(spark.createDataFrame(list(enumerate(values)), "id long, h long"), "id", "h", 8).collect()
    assert {(r["id"], r["fingerprint"], r["class"], r["links"]) for r in got} == {(i, v, kind[v], len(linked[v])) for i, v in enumerate(values)}


def test_near_members_read_links_once(spark, monkeypatch):
    """Long chains whose ends are far apart: classes without reading all links again in every round."""
    rng = random.Random(12)
    values = []
    for _ in range(3):
        v = rng.getrandbits(63)
        values.append(v)
        for _ in range(60):
            for bit in rng.sample(range(63), 6):
                v ^= 1 << bit
            values.append(v)
    whole = sorted(set(values))
    linked = {v: [u for u in whole if u != v and (u ^ v).bit_count() <= 8] for v in whole}
    kind = {}
    for v in whole:
        todo = [v]
        while todo:
            u = todo.pop()
            if u not in kind:
                kind[u] = v
                todo += linked[u]
    written = []
    keep = similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    monkeypatch.setattr(similarity, "forget", lambda *tables: None, raising=False)
    got = similarity.near_members(spark.createDataFrame(list(enumerate(values)), "id long, h long"), "id", "h", 8)
    assert {(r["id"], r["fingerprint"], r["class"], r["links"]) for r in got.collect()} == {(i, v, kind[v], len(linked[v])) for i, v in enumerate(values)}
    # Each round has fewer links than the one before, and the last none.
    sizes = [df.count() for label, df in written if label == "links"]
    assert sizes[0] == sum(map(len, linked.values())) // 2 and sizes[-1] == 0 and all(x > y for x, y in zip(sizes, sizes[1:], strict=False))


def test_diverse_looks_at_every_row(spark):
    rows = [(i, "g", "a", 1.0) for i in range(5100)] + [(9000, "g", "b", 0.9), (9001, "g", "b", None)]
    got = sampling.diverse(spark.createDataFrame(rows, "id long, grp string, f string, p double"), "grp", ["f"], "p", "id", 3).orderBy("pick").collect()
    assert [r["id"] for r in got] == [0, 9000, 1]


def test_whole_matrix_and_every_model(spark, data):
    from gradeworks.plans import base, learn_queries

    configs = [(r["config_id"], r["model_name"]) for r in base.table(spark, data, "model_configs").collect()]
    long = {(r["sample_id"], r["config_id"]): r["is_correct"] for r in base.matrix(spark, data).collect()}
    wide = learn_queries.whole_matrix(spark, data)
    assert sorted(wide.columns) == sorted(["sample_id", "observed", *(c for c, _ in configs)])
    for r in wide.collect():
        assert [r[c] for c, _ in configs] == [None if (v := long.get((r["sample_id"], c))) is None else int(v) for c, _ in configs]
    got = learn_queries.model_holdout_auc(spark, data).collect()
    aucs = {r["model_name"]: r["auc"] for r in got if r["figure"] == "model"}
    told = [a for a in aucs.values() if a is not None]
    assert set(aucs) == {m for _, m in configs}
    assert {r["figure"]: r["auc"] for r in got if r["figure"] != "model"} == pytest.approx({"mean": sum(told) / len(told), "least": min(told), "most": max(told)}, abs=1e-5)

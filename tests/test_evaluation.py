"""Routers, networks, studies and quotas against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeworks.functions import vectors
from gradeworks.operators import evaluation, networks, results, routers, sampling, similarity, statistics, studies
from gradeworks.plans import pipeline

MATRIX = "sample_id string, config_id string, tier int, cost double, is_correct boolean"


def matrix_rows(seed=1, n=60):
    rng = random.Random(seed)
    return [(f"s{i:02d}", f"c{j}", 1 + j // 2, float(1 + j) + i % 3 / 100, rng.random() < 0.3 + 0.1 * j) for i in range(n) for j in range(6) if rng.random() < 0.9]


def test_metrics_against_brute_force(spark):
    rows = matrix_rows()
    frame = spark.createDataFrame(rows, MATRIX)
    priced = evaluation.prices(frame)
    price = {r["config_id"]: r["price"] for r in priced.collect()}
    per = evaluation.routable(frame, priced)
    outcome = {(s, c): ok for s, c, _, _, ok in rows}
    ids = sorted({r[0] for r in rows})
    picks = {s: f"c{i % 6}" for i, s in enumerate(ids)}
    told = evaluation.metrics(evaluation.judged(spark.createDataFrame(list(picks.items()), "sample_id string, config_id string"), frame, per, priced), priced, "mine").first()
    right = [outcome.get((s, picks[s]), False) for s in ids]
    best = {s: min((price[c] for c in price if outcome.get((s, c))), default=None) for s in ids}
    routable = [s for s in ids if best[s] is not None]
    paid, oracle, top = sum(price[picks[s]] for s in routable), sum(best[s] for s in routable), max(price.values())
    assert (told["n_total"], told["n_correct"], told["n_routable"]) == (len(ids), sum(right), len(routable))
    assert told["total_cost"] == pytest.approx(sum(price[picks[s]] for s in ids), abs=1e-5)
    assert told["oracle_efficiency"] == pytest.approx(100 * (len(routable) * top - paid) / (len(routable) * top - oracle), abs=1e-3)
    groups = spark.createDataFrame([(s, str(i % 2)) for i, s in enumerate(ids)], "sample_id string, g string")
    shown = {r["g"]: (r["n_samples"], r["accuracy"]) for r in evaluation.breakdown(evaluation.judged(spark.createDataFrame(list(picks.items()), "sample_id string, config_id string"), frame, per, priced), groups, "g", ("0", "1", "none")).collect()}
    assert shown["none"] == (0, 0.0) and shown["0"][0] == (len(ids) + 1) // 2
    with pytest.raises(ValueError):
        evaluation.static_routes(per, priced, "other")


def test_ridge_against_direct_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5 + rng.normal(size=200)
    frame = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b), c in zip(range(200), x, y, strict=True)], "id int, a double, b double, y double")
    train, test = x[:160], x[160:]
    mean, base = train.mean(axis=0), y[:160].mean()
    w = np.linalg.solve((train - mean).T @ (train - mean) + np.eye(2), (train - mean).T @ (y[:160] - base))
    error = ((y[160:] - (base + (test - mean) @ w)) ** 2).sum()
    want = 1 - error / ((y[160:] - y[160:].mean()) ** 2).sum()
    assert evaluation.ridge_r2(frame, ["a", "b"], "y", ["id"]).first()["r2"] == pytest.approx(want, abs=1e-6)
    assert evaluation.ridge_r2(frame.limit(0), ["a"], "y", ["id"]).first()["r2"] is None


def training_rows(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random(), rng.random()
        tier = 1 if a < 0.4 else 2 if a < 0.7 else 3
        rows.append((f"s{i}", [a, b], tier, 1 + 3 * round(a, 2), f"c{tier}", tier == 1, tier <= 2, True, tier == 1, tier <= 2))
    return spark.createDataFrame(rows, "sample_id string, x array<double>, tier int, composite double, target string, right_1 boolean, right_2 boolean, right_3 boolean, any_1 boolean, any_2 boolean")


def prices_of(spark):
    return spark.createDataFrame([("c1", 1, 1.0), ("c2", 2, 2.0), ("c3", 3, 5.0)], "config_id string, tier int, price double")


def accuracy(router, rows):
    return router.predict(rows).join(rows.select("sample_id", "target"), "sample_id").agg(F.avg((F.col("config_id") == F.col("target")).cast("double"))).first()[0]


def test_threshold_router_finds_the_best_cuts(spark):
    rng = random.Random(6)
    data = [(f"s{i}", [0.0], 1, float(rng.randint(1, 12)), "x", *[rng.random() < 0.5 for _ in range(3)], False, False) for i in range(150)]
    rows = spark.createDataFrame(data, training_rows(spark, 1).schema)
    got = routers.ThresholdRouter(prices_of(spark)).fit(rows).cuts

    def hits(one, two):
        return sum(r[5] if r[3] <= one else r[6] if r[3] <= two else r[7] for r in data)

    values = sorted({r[3] for r in data})
    assert hits(*got) == max(hits(a, b) for a, b in itertools.combinations(values, 2))
    empty = routers.ThresholdRouter(prices_of(spark)).fit(rows.limit(0))
    assert empty.cuts == (1.5, 2.5)


def test_learned_routers_learn(spark):
    rows = training_rows(spark)
    price_of = {"c1": 1.0, "c2": 2.0, "c3": 5.0}
    cascade = routers.LearnedCascade(prices_of(spark)).fit(rows)
    assert accuracy(cascade, rows) > 0.9
    assert accuracy(routers.LogisticConfigRouter(sorted(price_of)).fit(rows), rows) > 0.9
    network = routers.CostSensitiveNetwork(price_of, 2, hidden=(16,), rounds=60).fit(rows)
    assert accuracy(network, rows) > 0.85 and network.weights[0] > network.weights[2]
    two = rows.withColumn("model", F.col("tier") - 1).withColumn("budget_targets", F.array(*[F.when(F.col("tier") == t, F.log1p(F.lit(100.0))).otherwise(F.lit(float("nan"))) for t in (1, 2, 3)])).withColumn("full", F.col("sample_id") < "s2").withColumn("seen", F.when(F.col("full"), 1.0).otherwise(0.5))
    phases = routers.TwoPhaseNetwork(["m1", "m2", "m3"], {("m1", 0): "c1", ("m1", 128): "c1", ("m2", 128): "c2", ("m3", 128): "c3"}, 2, hidden=(16,), rounds=(40, 40)).fit(two)
    assert accuracy(phases, two) > 0.85
    for router in (cascade, network, phases):
        assert router.name and router.predict(rows.limit(0) if router is not phases else two.limit(0)).count() == 0


def test_gradients():
    layers = networks.fresh([3, 4, 5], 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 3))
    frame = pd.DataFrame({"target": rng.integers(0, 3, 6), "weight": rng.random(6), "budget": [[1.0, float("nan")] for _ in range(6)]})
    frame["choice"] = [0, 1, -1, 2, 0, -1]
    for loss, width in ((networks.class_loss([1, 2, 3, 1, 1], row_weight="weight"), 5), (networks.choice_and_budget_loss(3, "choice", "budget", "weight"), 5)):
        values = networks.forward(layers, x)
        _, by_out = loss(values[-1], frame)
        grad = networks.backward(layers, values, by_out)
        flat = networks._flat(layers)
        for k in (0, 7, 20, len(flat) - 1):
            moved = flat.copy()
            moved[k] += 1e-6
            up = loss(networks.forward(networks._shaped(moved, layers), x)[-1], frame)[0]
            moved[k] -= 2e-6
            down = loss(networks.forward(networks._shaped(moved, layers), x)[-1], frame)[0]
            assert grad[k] == pytest.approx((up - down) / 2e-6, abs=1e-4), (width, k)


def test_perturbation_moments_and_trials(spark):
    rng = random.Random(7)
    rows = [(f"s{i}", rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([None, 2.0, 2.6, 3.1])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id string, p boolean, q boolean, c double")
    exact, drawn = studies.perturbed(frame, ["p", "q"], "c").first(), studies.perturbation_trials(frame, ["p", "q"], "c", trials=400).first()

    def tier(p, q, c):
        seen = [x for x in (p, q) if x is not None]
        return None if not seen else 1 if all(seen) else (3 if c >= 2.8 else 2) if not any(seen) else (2 if c < 2.5 else 3)

    share = []
    for _ in range(300):
        kept = [tier(*[None if x is None else x ^ (rng.random() < 0.1) for x in (p, q)], c) == tier(p, q, c) for _, p, q, c in rows if c is not None and (p is not None or q is not None)]
        share.append(np.mean(kept))
    assert exact["mean"] == pytest.approx(np.mean(share), abs=0.006) and drawn["mean"] == pytest.approx(exact["mean"], abs=0.004)
    assert drawn["deviation"] == pytest.approx(exact["deviation"], rel=0.2) and drawn["least"] <= drawn["mean"] <= drawn["most"]
    assert studies.perturbation_trials(frame.limit(0), ["p", "q"], "c").first()["mean"] is None


def test_shares_and_floors(spark):
    rng = random.Random(8)
    for size in (10, 37, 500):
        counts = [(f"g{i}", rng.randint(1, 60)) for i in range(12)]
        got = {r["g"]: r["quota"] for r in studies.shares_of(spark.createDataFrame(counts, "g string, n long"), size).collect()}
        assert all(1 <= got[g] <= n for g, n in counts) and sum(got.values()) <= size + 12
        assert sum(got.values()) >= min(size, sum(n for _, n in counts)) - 12
    rows = [(f"s{i}", "big" if i < 300 else "mid" if i < 360 else f"t{i % 3}") for i in range(390)]
    frame = spark.createDataFrame(rows, "id string, g string")
    got = {r["g"]: r["count"] for r in studies.floored(frame, "g", 100, 8, "id").groupBy("g").count().collect()}
    assert sum(got.values()) == 100 and min(got.values()) == 8 and got["mid"] >= 8
    assert studies.floored(frame.limit(0), "g", 100, 8, "id").count() == 0


def test_hash_links_do_not_depend_on_blocks(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(6):
            v = b
            for k in rng.sample(range(64), rng.randint(1, 9)):
                v ^= 1 << k if k < 63 else -(1 << 63)
            values.add(v)
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(values, 2) if ((a ^ b) & mask).bit_count() <= 8}
    frame = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    for keep in (1, 2, 3, None):
        got = similarity.near_hashes(frame, "id", "h", 8, keep=keep).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_hash_links_are_not_broadcast(spark):
    """Every value meets others by many keys: a plan that broadcasts them holds them all in the driver."""
    rng = np.random.default_rng(11)
    half = rng.integers(0, 1 << 32, 6000) << np.int64(31)  # all agree in the low blocks: one group is cut further
    flips = np.int64(1) << rng.integers(31, 63, (6000, 5))
    values = np.unique(np.concatenate([half, half ^ np.bitwise_xor.reduce(flips, axis=1)]))
    want = set()
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 8)
        want |= {(int(values[i]), int(values[i + 1 + j])) for j in near}
    links = similarity.near_hashes(spark.createDataFrame(list(enumerate(values.tolist())), "id long, h long"), "id", "h", 8)
    assert "Broadcast" not in links._jdf.queryExecution().toString()
    got = links.collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(r["distance"] == (r["a"] ^ r["b"]).bit_count() for r in got)


def test_neighbours_in_blocks_of_queries(spark):
    rng = np.random.default_rng(10)
    frame = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=6)]) for i in range(80)], "id long, v array<double>")
    one, two = (sorted(map(tuple, similarity.neighbours(frame.where("id % 4 = 0"), frame, "id", "v", 3, most=m).collect())) for m in (1000, 5))
    assert one == two and len(one) == 60


def test_representatives_in_rounds(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 4)) * 20
    rows = [(i, [float(v) for v in centres[i % 8] + rng.normal(size=4) * 0.1]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    for group_rows in (1000, 60):
        picked = [r["id"] % 8 for r in sampling.facility_location(frame, "v", "id", 8, 1.0, group_rows=group_rows).collect()]
        assert sorted(picked) == list(range(8)), group_rows


def test_two_signals_and_claims(spark):
    rows = [("a", "t1", "i1", 1), ("b", "t1", "i1", 2), ("c", "t1", "i2", 1), ("d", "t1", None, 9), ("e", "t2", "i1", 1), ("f", "t3", None, 1), ("g", "t3", " ", 1)]
    frame = spark.createDataFrame(rows, "id string, t string, path string, p int")
    got = {r["id"]: r["n_rows"] for r in results.two_signal_dedup(frame, F.col("t"), results.image_key(F.col("path")), F.col("p"), "id").collect()}
    least_is_first = F.md5(F.lit("i1")), F.md5(F.lit("i2"))
    first = spark.range(1).select(least_is_first[0] < least_is_first[1]).first()[0]
    assert got == ({"d": 3, "c": 1, "e": 1, "f": 2} if first else {"b": 2, "d": 2, "e": 1, "f": 2})
    figures = spark.createDataFrame([("x", 0.5), ("y", None)], "name string, value double")
    told = results.check_claims(figures, [("x", "near", 0.51, 0.02), ("x", "least", 0.6, 0.0), ("x", "most", 0.6, 0.0), ("y", "near", 0.0, 1.0), ("z", "near", 0.0, 1.0)])
    assert sorted((r["name"], r["kind"], r["holds"]) for r in told.collect()) == [("x", "least", False), ("x", "most", True), ("x", "near", True), ("y", "near", False), ("z", "near", False)]


def test_cluster_bootstrap_keeps_clusters_together(spark):
    rng = random.Random(12)
    rows = [(f"s{i}", float(v), 10.0) for i in range(300) for v in [rng.choice([0, 10])]]
    got = statistics.bootstrap_ratio(spark.createDataFrame(rows, "id string, k double, n double"), "id", "k", "n").first()
    p = np.mean([r[1] / 10 for r in rows])
    assert got["mean"] == pytest.approx(p, abs=0.01) and got["high"] - got["low"] == pytest.approx(2 * 1.96 * np.sqrt(p * (1 - p) / 300), rel=0.25)


def test_selection_stages(spark, tmp_path):
    rng = random.Random(13)
    rows = [(f"s{i}", rng.choice(("T1", "T2", "T3")), rng.randint(1, 3), rng.choice(("DocVQA", "CORD")), rng.randint(1, 4), rng.randint(1, 4), rng.randint(1, 4), rng.random() < 0.5, rng.random() < 0.5) for i in range(400)]
    frame = spark.createDataFrame(rows, "sample_id string, task string, tier int, source_dataset string, vds int, rds int, ses int, has_table boolean, has_chart boolean")
    stages = pipeline.selection_stages(60, 40, (("task", 6), ("tier", 8)))
    assert set(pipeline.run(spark, stages, str(tmp_path), {"samples": frame}).values()) == {"made"}
    anchors, valid = spark.read.parquet(f"{tmp_path}/anchors"), spark.read.parquet(f"{tmp_path}/validation")
    assert anchors.count() == 60 and valid.count() == 40 and anchors.join(valid, "sample_id").count() == 0
    by = {r["task"]: r["count"] for r in anchors.join(frame, "sample_id").groupBy("task").count().collect()}
    assert all(by[t] >= 6 for t in ("T1", "T2", "T3"))
    assert spark.read.parquet(f"{tmp_path}/selection_report").agg(F.sum("n")).first()[0] == 100
    assert set(pipeline.run(spark, stages, str(tmp_path), {"samples": frame}).values()) == {"done"}


def test_vectors(spark):
    one = spark.range(1).select(
        vectors.budget_for(F.log1p(F.lit(1500.0)), (0, 1024, 4096)).alias("b"),
        vectors.exponent_order(F.array(F.lit(0.2), F.lit(0.9), F.lit(0.2))).alias("o"),
        F.size(vectors.sample_embedding(F.lit("T1"), F.lit(1), F.lit("doc vqa"), [F.lit(1)] * 3, F.lit(True), F.lit(None).cast("boolean"))).alias("n"),
        vectors.probe_agreement(F.lit(True), F.lit(None).cast("boolean")).alias("a"),
        vectors.complexity_bin([F.lit(2), F.lit(2), F.lit(2)]).alias("c"),
    ).first()
    assert (one["b"], one["o"], one["n"], one["a"], one["c"]) == (4096, [1, 0, 2], 30, "disagree", "medium")

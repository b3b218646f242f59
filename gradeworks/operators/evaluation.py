"""Evaluation of routers: prices, predictions of plain routers, metrics, breakdowns and gaps.

Predictions are a table ``(sample_id, config_id)``.  A configuration that was not tried on a sample
counts as wrong there.  Prices are one row per configuration and are broadcast: their number is that
of the configurations, not of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bell, expected_rank

#: Chances of the tiers where only a hard tier is known, and centres and width of the complexity of tiers.
SOFT = {1: (0.70, 0.25, 0.05), 2: (0.15, 0.65, 0.20), 3: (0.10, 0.20, 0.70)}
CENTRES, WIDTH = (1.5, 2.5, 3.5), 0.6


def prices(matrix: DataFrame) -> DataFrame:
    """Per configuration its tier and mean cost, 8 places."""
    return matrix.groupBy("config_id").agg(F.min("tier").alias("tier"), F.round(F.avg("cost"), 8).alias("price"))


def routable(matrix: DataFrame, priced: DataFrame) -> DataFrame:
    """Per sample whether any configuration was correct, and the cheapest correct one with its price."""
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    best = F.min(F.when(right, F.struct("price", "config_id")))
    per = matrix.select("sample_id", "config_id", "is_correct").join(F.broadcast(priced.select("config_id", "price")), "config_id")
    per = per.groupBy("sample_id").agg(best.alias("b"), F.bool_or(right).alias("routable"))
    return per.select("sample_id", "routable", F.col("b.config_id").alias("best_config"), F.col("b.price").alias("best_price"))


def cheapest_of_tiers(priced: DataFrame) -> DataFrame:
    """One row: the cheapest configuration of each tier (t1, t2, t3), of all, and the dearest of all."""
    key = F.struct("price", "config_id")
    tiers = [F.min(F.when(F.col("tier") == t, key))["config_id"].alias(f"t{t}") for t in (1, 2, 3)]
    dearest = F.min(F.struct((-F.col("price")).alias("p"), "config_id"))["config_id"]
    return priced.agg(*tiers, F.min(key)["config_id"].alias("cheapest"), dearest.alias("dearest"))


def static_routes(samples: DataFrame, priced: DataFrame, kind: str, seed: int = 42) -> DataFrame:
    """One configuration for every sample: ``cheapest``, ``dearest`` or ``random`` by hash of the id."""
    if kind in ("cheapest", "dearest"):
        return samples.select("sample_id").join(F.broadcast(cheapest_of_tiers(priced).select(F.col(kind).alias("config_id"))))
    if kind != "random":
        raise ValueError(f"no static router {kind}")
    listed = priced.agg(F.array_sort(F.collect_list("config_id")).alias("__all"))
    u = F.conv(F.substring(F.md5(F.concat("sample_id", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return samples.select("sample_id").join(F.broadcast(listed)).select("sample_id", F.get("__all", F.pmod(u, F.size("__all")).cast("int")).alias("config_id"))


def tier_routes(tiers: DataFrame, priced: DataFrame, tier: str = "tier") -> DataFrame:
    """The cheapest configuration of the tier that is wanted for a sample, of all for an unknown tier."""
    wanted = F.when(F.col(tier) == 1, F.col("t1")).when(F.col(tier) == 2, F.col("t2")).when(F.col(tier) == 3, F.col("t3"))
    return tiers.join(F.broadcast(cheapest_of_tiers(priced))).select("sample_id", F.coalesce(wanted, "cheapest").alias("config_id"))


def oracle_routes(per: DataFrame, priced: DataFrame, tiers: DataFrame) -> DataFrame:
    """The cheapest correct configuration; without one the cheapest of the sample's tier."""
    plain = tier_routes(per.select("sample_id").join(tiers.select("sample_id", "tier"), "sample_id", "left"), priced)
    return per.join(plain, "sample_id").select("sample_id", F.coalesce("best_config", "config_id").alias("config_id"))


def judged(predictions: DataFrame, matrix: DataFrame, per: DataFrame, priced: DataFrame) -> DataFrame:
    """Per sample of ``per``: the predicted configuration, its price, whether it is correct, and what the oracle has."""
    outcome = matrix.select("sample_id", "config_id", F.coalesce("is_correct", F.lit(False)).alias("correct"))
    rows = per.join(predictions.select("sample_id", "config_id"), "sample_id").join(outcome, ["sample_id", "config_id"], "left")
    rows = rows.join(F.broadcast(priced.select("config_id", "price")), "config_id", "left")
    return rows.select("sample_id", "config_id", "routable", "best_price", "price", F.coalesce("correct", F.lit(False)).alias("correct"))


def metrics(rows: DataFrame, priced: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per router (and group): accuracy, costs, cost per correct answer, efficiency against the oracle.

    ``rows`` are those of :func:`judged`.  Efficiency is the part of the oracle's saving against the
    dearest configuration that the router reaches on routable samples, between 0 and 100.
    """
    r = F.col("routable")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("correct").alias("n_correct"),
        F.count_if(r).alias("n_routable"),
        F.count_if(r & F.col("correct")).alias("__right"),
        F.sum("price").alias("__cost"),
        F.coalesce(F.sum(F.when(r, F.col("price"))), F.lit(0.0)).alias("__paid"),
        F.coalesce(F.sum(F.when(r, F.col("best_price"))), F.lit(0.0)).alias("__oracle"),
    )
    top = priced.agg(F.max("price").alias("__top"))
    saved = F.try_divide(F.col("n_routable") * F.col("__top") - F.col("__paid"), F.col("n_routable") * F.col("__top") - F.col("__oracle"))
    efficiency = F.when(F.col("n_routable") * F.col("__top") > F.col("__oracle"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * saved))).otherwise(0.0)
    return sums.join(F.broadcast(top)).select(
        F.lit(name).alias("router"),
        *by,
        "n_total",
        "n_correct",
        "n_routable",
        F.round(F.try_divide(F.col("n_correct"), F.col("n_total")), 6).alias("accuracy"),
        F.round(F.coalesce(F.try_divide(F.col("__right"), F.col("n_routable")), F.lit(0.0)), 6).alias("accuracy_routable"),
        F.round("__cost", 6).alias("total_cost"),
        F.round(F.try_divide(F.col("__cost"), F.col("n_total")), 8).alias("avg_cost"),
        F.round(F.try_divide(F.col("__cost"), F.col("n_correct")), 8).alias("cost_per_correct"),
        F.round("__paid", 6).alias("total_cost_routable"),
        F.round(efficiency, 4).alias("oracle_efficiency"),
    )


def breakdown(rows: DataFrame, groups: DataFrame, column: str, domain: Sequence[object]) -> DataFrame:
    """Per value of a domain: samples, accuracy and mean cost of a router; zeros for a value without samples."""
    listed = F.explode(F.array(*[F.lit(x) for x in domain])).alias(column)
    found = rows.join(groups.select("sample_id", column), "sample_id").groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("a"), F.avg("price").alias("c"))
    whole = rows.sparkSession.range(1).select(listed)
    return whole.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n_samples"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("accuracy"), F.round(F.coalesce("c", F.lit(0.0)), 8).alias("avg_cost"))


def mode_routes(rows: DataFrame, modes: DataFrame, keys: Sequence[str], target: str, fallback: int = 2) -> DataFrame:
    """``rows`` with the most frequent target of their keys, ``fallback`` for unknown keys, and whether it is right.

    A row whose own target is null is never right.
    """
    told = modes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(target).alias("__told"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.join(F.broadcast(told), same, "left").withColumn("predicted", F.coalesce("__told", F.lit(fallback)))
    return out.select(*rows.columns, "predicted", F.coalesce(F.col("predicted") == F.col(target), F.lit(False)).alias("right"))


def recommendations(accuracy: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per task: best and worst model, their spread, and which tier to route to.

    ``accuracy`` has (model_name, task, a), ``tiers`` (model_name, tier).  A spread below 0.05 makes
    tier A enough; else the gap between the means of tiers C and A decides at 0.10 and 0.05.
    """
    t = accuracy.join(F.broadcast(tiers), "model_name").groupBy("task").agg(
        F.min(F.struct((-F.col("a")).alias("o"), "model_name"))["model_name"].alias("best_model"),
        F.min(F.struct("a", "model_name"))["model_name"].alias("worst_model"),
        (F.max("a") - F.min("a")).alias("s"),
        (F.coalesce(F.avg(F.when(F.col("tier") == 3, F.col("a"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(F.col("tier") == 1, F.col("a"))), F.lit(0.0))).alias("g"),
    )
    advice = F.when(F.col("s") < 0.05, "tier A").when(F.col("g") > 0.10, "tier C").when(F.col("g") > 0.05, "tier B or C").otherwise("tier B")
    return t.select("task", "best_model", "worst_model", F.round("s", 6).alias("spread"), F.round("g", 6).alias("gap"), advice.alias("advice"))


def disagreements(rows: DataFrame, rule: str, judge: str, needed: str | None = None) -> DataFrame:
    """Rows marked as needing an arbiter, or, without a mark, whose rule and judge differ; no judge, no disagreement."""
    return rows.where(F.col(needed)) if needed else rows.where(F.col(judge).isNotNull() & (F.coalesce(F.col(rule), F.lit(False)) != F.col(judge)))


def arbitration(rows: DataFrame, verdict: str, rule: str, judge: str, confidence: Column) -> DataFrame:
    """One row: disagreements, with whom the arbiter agrees, and how sure it is (high, medium, low)."""
    v = F.coalesce(F.col(verdict), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v == F.coalesce(F.col(rule), F.lit(False))).alias("with_rule"),
        F.count_if(v == F.coalesce(F.col(judge), F.lit(False))).alias("with_judge"),
        *[F.count_if(confidence == c).alias(c) for c in ("high", "medium", "low")],
    )


def ridge_r2(rows: DataFrame, features: Sequence[str], target: str, order: Sequence[str], share: float = 0.8, penalty: float = 1.0) -> DataFrame:
    """R squared on the last rows of a linear model with a ridge penalty, fitted on the first ``share`` of them.

    The sums of products that the closed form needs are one aggregate, whatever the number of rows;
    the intercept is not penalised.  Null without spread or rows.
    """
    import numpy as np

    from .sampling import ranked_in_groups

    plain = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    names = [f"x{i}" for i in range(len(features))]
    known = plain.where(F.col("y").isNotNull()).fillna(0.0, names).withColumn("__all", F.lit(1))
    placed = ranked_in_groups(known, ["__all"], [F.col(f"o{i}") for i in range(len(order))])
    first = F.col("__rank") <= F.floor(F.col("__rank_of") * F.lit(share))
    spread = [*names, "y"]
    pairs = [(a, b) for i, a in enumerate(spread) for b in spread[i:]]
    sums = placed.groupBy(first.alias("train")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in spread], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs])
    got = {r["train"]: r for r in sums.collect()}
    schema = "r2 double"
    if set(got) != {True, False}:
        return rows.sparkSession.createDataFrame([(None,)], schema)

    def moments(r) -> tuple[float, np.ndarray, np.ndarray]:
        p = np.zeros((len(spread), len(spread)))
        for i, a in enumerate(spread):
            for j in range(i, len(spread)):
                p[i, j] = p[j, i] = r[f"p_{a}_{spread[j]}"]
        return float(r["n"]), np.array([r[f"s_{c}"] for c in spread]), p

    n, s, p = moments(got[True])
    centred = p - np.outer(s, s) / n
    k = len(names)
    weights = np.linalg.solve(centred[:k, :k] + penalty * np.eye(k), centred[:k, k])
    base = s[k] / n - weights @ s[:k] / n
    m, t, q = moments(got[False])
    w = np.concatenate([-weights, [1.0]])
    error = w @ q @ w - 2 * base * (w @ t) + m * base * base
    whole = q[k, k] - t[k] * t[k] / m
    return rows.sparkSession.createDataFrame([(round(float(1 - error / whole), 6) if whole > 0 else None,)], schema)


def resolved_prior(soft: Column, tier: Column) -> tuple[Column, Column]:
    """The hard tier and the chances of the tiers: as given, else from the hard tier, else even; they sum to 1."""
    even = F.array(*[F.lit(1.0 / 3)] * 3)
    told = F.lit(None).cast("array<double>")
    for t, chances in SOFT.items():
        told = F.when(tier == t, F.array(*map(F.lit, chances))).otherwise(told)
    own = F.coalesce(soft, told, even)
    total = own[0] + own[1] + own[2]
    chances = F.array(*[F.when(total > 0, own[i] / total).otherwise(1.0 / 3) for i in range(3)])
    return F.coalesce(tier, first_largest(own)).cast("int"), chances


def first_largest(soft: Column) -> Column:
    """The place, from 1, of the largest entry, the first on a tie."""
    return F.array_position(soft, F.array_max(soft)).cast("int")


def likelihoods(matrix: DataFrame, tasks: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per configuration, task and tier the chance of a correct answer, with one success and one failure added."""
    rows = matrix.where("is_correct is not null").join(tasks, "sample_id").join(tiers, "sample_id")
    return rows.groupBy("config_id", "task", F.col("tier_of").alias("tier_of")).agg(F.round((F.count_if("is_correct") + 1) / (F.count(F.lit(1)) + 2), 6).alias("chance"))


def difficulty(rows: DataFrame, first: Column, second: Column, composite: Column) -> DataFrame:
    """The difficulty record of each sample.

    ``rows`` has soft (chances of the tiers), tier_prior, and first_chances, second_chances (chances
    of a correct answer by tier, null without a probe).  The posterior multiplies prior, outcomes and
    a normal likelihood of the probed composite; missing evidence changes nothing.
    """
    tier, prior = resolved_prior(F.col("soft"), F.col("tier_prior"))

    def seen(outcome: Column, chances: str, i: int) -> Column:
        p = F.col(chances)[i]
        return F.when(outcome.isNull() | p.isNull(), 1.0).when(outcome, p).otherwise(1.0 - p)

    def shape(i: int) -> Column:
        return F.when(composite.isNull(), 1.0).otherwise(bell(composite, CENTRES[i], WIDTH))

    # Three tiers, three plain expressions: nothing is evaluated inside a function over an array.
    joint = [prior[i] * seen(first, "first_chances", i) * seen(second, "second_chances", i) * shape(i) for i in range(3)]
    total = joint[0] + joint[1] + joint[2]
    posterior = F.array(*[F.round(F.when(total > 0, x / total).otherwise(1.0 / 3), 6) for x in joint])
    agreement = F.when(first.isNull() & second.isNull(), "missing").when(first.eqNullSafe(second), F.when(first, "both_correct").otherwise("both_wrong")).otherwise("disagree")
    probes = first.isNotNull().cast("int") + second.isNotNull().cast("int")
    out = rows.select("sample_id", tier.alias("tier_prior"), posterior.alias("tier_soft"), agreement.alias("probe_agreement"), probes.alias("n_probes"))
    return out.withColumns({"tier_final": first_largest(F.col("tier_soft")), "difficulty": F.round(expected_rank(F.col("tier_soft")), 4), "confidence": F.array_max("tier_soft")})


def swap_orders(rows: DataFrame, group: str, confidence: str, identity: str, n: int) -> DataFrame:
    """The ``n`` surest and the ``n`` least sure rows of each group, as candidates to give and to take: side, place.

    Ties go to the smaller id.
    """
    out = None
    for side, order in (("give", F.asc(confidence)), ("take", F.desc(confidence))):
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, identity))).where(F.col("place") <= n)
        one = ranked.select(group, identity, F.lit(side).alias("side"), "place")
        out = one if out is None else out.unionByName(one)
    return out


def confidence_sweep(scored: DataFrame, chance: str, label: str, widths: Sequence[float] = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)) -> DataFrame:
    """Per width the share of rows whose chance lies within it of 0 or 1, and how often those are right.

    One aggregate with a pair of columns for each width; accuracy is 0 where no row is sure.
    """
    right = (F.col(chance) >= 0.5) == F.col(label)
    sure = [(F.col(chance) > 1 - w) | (F.col(chance) < w) for w in widths]
    wide = scored.where(F.col(label).isNotNull() & F.col(chance).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s).alias(f"s{i}") for i, s in enumerate(sure)], *[F.count_if(s & right).alias(f"r{i}") for i, s in enumerate(sure)])
    listed = F.inline(F.array(*[F.struct(F.lit(w).alias("width"), F.round(F.coalesce(F.try_divide(F.col(f"s{i}"), F.col("n")), F.lit(0.0)), 6).alias("share"), F.round(F.coalesce(F.try_divide(F.col(f"r{i}"), F.col(f"s{i}")), F.lit(0.0)), 6).alias("accuracy")) for i, w in enumerate(widths)]))
    return wide.select(listed)

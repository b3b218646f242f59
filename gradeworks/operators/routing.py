"""Routing: cheapest correct configurations, cascades, dominance, regret, frontiers and votes.

The evaluation matrix is a long table: one row per sample and configuration, with tier, cost and
whether it was correct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson


def cheapest(matrix: DataFrame, order: Sequence[str | Column], correct: str = "is_correct", key: str = "sample_id", pick: str = "config_id") -> DataFrame:
    """Per sample the correct configuration that comes first, null where none is, and how many are."""
    right = F.coalesce(F.col(correct), F.lit(False))
    best = F.min(F.when(right, F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)], F.col(pick).alias("pick"))))["pick"]
    return matrix.groupBy(key).agg(best.alias(pick), F.count_if(right).alias("n_correct"), F.count(F.lit(1)).alias("n_configs"))


def cascade(matrix: DataFrame, stop: Column | None = None, key: str = "sample_id") -> DataFrame:
    """A cascade over tiers: the first tier with a correct configuration, and the cheapest in it.

    ``stop`` is the last tier a sample may reach; beyond it nothing is tried.
    """
    allowed = matrix if stop is None else matrix.where(F.col("tier") <= stop)
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    best = F.min(F.when(right, F.struct("tier", "cost", "config_id")))
    spent = allowed.groupBy(key).agg(best.alias("b"), F.collect_list(F.struct("tier", "cost")).alias("__all"))
    return spent.select(key, F.col("b.config_id").alias("config_id"), F.col("b.tier").alias("tier"), F.coalesce(F.size(F.filter("__all", lambda x: F.col("b.tier").isNull() | (x["tier"] <= F.col("b.tier")))), F.lit(0)).alias("calls"))


def violations(matrix: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ordered pairs of a correct configuration of a lower tier and any of a higher one.

    ``pairs`` counts them, ``violated`` those whose dearer side is wrong.  Counts per tier stand for
    the self join: a sample costs one row, not one per pair.
    """
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    per = matrix.groupBy(key).agg(*[F.count_if(right & (F.col("tier") == t)).alias(f"r{t}") for t in (1, 2, 3)], *[F.count_if(F.col("tier") == t).alias(f"n{t}") for t in (1, 2, 3)])
    pairs = F.expr("r1 * (n2 + n3) + r2 * n3")
    wrong = F.expr("r1 * (n2 - r2 + n3 - r3) + r2 * (n3 - r3)")
    return per.select(key, pairs.alias("pairs"), wrong.alias("violated"))


def violation_rate(matrix: DataFrame, by: str | None = None, key: str = "sample_id") -> DataFrame:
    """The share of violated pairs with Wilson's interval, over all samples or by a column of them."""
    per = violations(matrix, key)
    if by:
        per = per.join(matrix.groupBy(key).agg(F.min(by).alias(by)), key)
    total = per.groupBy(*([by] if by else [])).agg(F.sum("violated").alias("violated"), F.sum("pairs").alias("pairs"))
    low, high = wilson(F.col("violated"), F.col("pairs"))
    return total.select(*([by] if by else []), "violated", "pairs", F.round(F.try_divide(F.col("violated"), F.col("pairs")), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def cheaper_than_pick(matrix: DataFrame, picks: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample how many configurations are cheaper than its pick, and how many of them are correct."""
    joined = matrix.join(picks.select(key, F.col("config_id").alias("__pick")), key)
    own = Window.partitionBy(key)
    priced = joined.withColumn("__cost", F.max(F.when(F.col("config_id") == F.col("__pick"), F.col("cost"))).over(own))
    cheap = priced.where(F.col("cost") < F.col("__cost"))
    return cheap.groupBy(key).agg(F.count(F.lit(1)).alias("cheaper"), F.count_if(F.coalesce("is_correct", F.lit(False))).alias("cheaper_correct"))


def regret(matrix: DataFrame, picks: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per routable sample, the cost of its pick beyond that of the cheapest correct configuration."""
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    chosen = matrix.join(picks.select(key, F.col("config_id").alias("__pick")), key)
    per = chosen.groupBy(key).agg(F.min(F.when(right, F.col("cost"))).alias("best"), F.max(F.when(F.col("config_id") == F.col("__pick"), F.col("cost"))).alias("paid"))
    return per.where("best is not null and paid is not null").select(key, F.greatest(F.lit(0.0), F.col("paid") - F.col("best")).alias("regret"))


def regret_summary(regrets: DataFrame, scale: float = 1e6) -> DataFrame:
    """Count, mean, largest, 95th percentile (linear) and share of zero regrets, in millionths."""
    x = F.col("regret") * scale
    return regrets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.max(x), 4).alias("largest"), F.round(F.percentile(x, F.lit(0.95)), 4).alias("p95"), F.count_if(F.col("regret") == 0).alias("zero"), F.round(F.avg((F.col("regret") == 0).cast("double")), 6).alias("zero_share"))


def spent_until_right(matrix: DataFrame, key: str = "sample_id") -> DataFrame:
    """The cost of trying configurations from the cheapest on until one is correct, or all of them."""
    running = Window.partitionBy(key).orderBy("cost", "config_id").rowsBetween(Window.unboundedPreceding, 0)
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    tried = matrix.withColumn("__sum", F.sum("cost").over(running))
    return tried.groupBy(key).agg(F.coalesce(F.min(F.when(right, F.col("__sum"))), F.max("__sum")).alias("spent"))


def strict_frontier(points: DataFrame, cost: str = "cost", value: str = "accuracy") -> DataFrame:
    """Points that no other beats in both cost and value; equal points stay.

    A point is beaten when some strictly cheaper one has a strictly higher value: one running
    maximum over costs tells, instead of a join of all with all.
    """
    before = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    tops = points.groupBy(cost).agg(F.max(value).alias("__top")).withColumn("__before", F.max("__top").over(before)).select(cost, "__before")
    return points.join(tops, cost).where(F.col("__before").isNull() | (F.col("__before") <= F.col(value))).drop("__before")


def running_frontier(points: DataFrame, cost: str = "cost", value: str = "accuracy", identity: str = "config_id") -> DataFrame:
    """Points in order of value from the highest, those cheaper than all before them."""
    before = Window.orderBy(F.desc(value), cost, identity).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("__least", F.min(cost).over(before)).withColumn("on_frontier", F.col("__least").isNull() | (F.col(cost) < F.col("__least"))).drop("__least")


def mode_map(rows: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """The most frequent target of each combination of keys, the smaller on a tie."""
    counts = rows.where(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("__n"), F.col(target)))[target].alias(target))


def churn(matrix: DataFrame, model: str = "model_name", key: str = "sample_id") -> DataFrame:
    """Per model, the share of routable samples whose cheapest correct model changes without it.

    A label changes exactly where the model is the label, so one pass over the labels is enough.
    """
    order = F.struct("tier", "cost", "config_id")
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    label = matrix.groupBy(key).agg(F.min_by(model, F.when(right, order)).alias(model), F.count_if(right).alias("__n")).where("__n > 0")
    total = label.agg(F.count(F.lit(1)).alias("__total"))
    return label.groupBy(model).agg(F.count(F.lit(1)).alias("changed")).join(F.broadcast(total)).select(model, "changed", F.round(F.col("changed") / F.col("__total"), 6).alias("churn"))

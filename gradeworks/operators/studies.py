"""Studies of stability: probes, ablations, perturbations, permutations, floors and seeds."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize
from .sampling import hash_order


def probe_tier(outcomes: Sequence[Column], composite: Column) -> Column:
    """1 if all probes are right; 3 or 2 if all are wrong, 3 or 2 if mixed, by the composite; null without probes."""
    seen = F.array_compact(F.array(*outcomes))
    right = F.size(F.filter(seen, lambda x: x))
    return F.when(F.size(seen) == 0, F.lit(None).cast("int")).when(right == F.size(seen), 1).when(right == 0, F.when(composite >= 2.8, 3).otherwise(2)).otherwise(F.when(composite < 2.5, 2).otherwise(3))


def perturbation_states(rows: DataFrame, outcomes: Sequence[str], composite: str) -> DataFrame:
    """How many rows share their outcomes and the class of their composite, which are all a probe tier rests on.

    One aggregate; there are at most three values for each outcome and three classes.
    """
    shown = F.when(F.col(composite) < 2.5, 2.4).when(F.col(composite) < 2.8, 2.6).otherwise(2.9)
    return rows.groupBy(*outcomes, shown.alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def survival(rows: DataFrame, outcomes: Sequence[str], composite: str, rate: float = 0.1) -> DataFrame:
    """Per state of outcomes and composite: rows, and the chance that the probe tier stays when each outcome flips with ``rate``.

    The chance is the sum over all ways to flip; states without an outcome or a composite have no tier and are left out.
    """
    states = perturbation_states(rows.where(F.col(composite).isNotNull()), outcomes, composite)
    base = probe_tier([F.col(c) for c in outcomes], F.col("shown"))
    stays = F.lit(0.0)
    for flips in itertools.product((False, True), repeat=len(outcomes)):
        weight = F.lit(1.0)
        for c, flip in zip(outcomes, flips, strict=True):
            weight = weight * F.when(F.col(c).isNull(), F.lit(0.0) if flip else F.lit(1.0)).otherwise(rate if flip else 1 - rate)
        moved = probe_tier([F.when(F.lit(flip), ~F.col(c)).otherwise(F.col(c)) for c, flip in zip(outcomes, flips, strict=True)], F.col("shown"))
        stays = stays + F.when(moved == base, weight).otherwise(0.0)
    return states.where(base.isNotNull()).select("n", stays.alias("stays"))


def perturbed(rows: DataFrame, outcomes: Sequence[str], composite: str, rate: float = 0.1) -> DataFrame:
    """How often the probe tier survives when outcomes flip at random: exact mean and deviation of a trial's share."""
    s = survival(rows, outcomes, composite, rate)
    n, p = F.col("n"), F.col("stays")
    return s.agg(F.round(F.try_divide(F.sum(n * p), F.sum(n)), 6).alias("mean"), F.round(F.try_divide(F.sqrt(F.sum(n * p * (1 - p))), F.sum(n)), 6).alias("deviation"))


def perturbation_trials(rows: DataFrame, outcomes: Sequence[str], composite: str, rate: float = 0.1, trials: int = 100, seed: int = 42) -> DataFrame:
    """Mean, deviation, least and most of the surviving share over simulated trials.

    A trial draws, for each state, how many of its rows keep their tier; only the few states are
    gathered, whatever the number of rows.
    """
    states = sorted((r["n"], r["stays"]) for r in survival(rows, outcomes, composite, rate).collect())
    schema = "mean double, deviation double, least double, most double"
    if not states:
        return rows.sparkSession.createDataFrame([(None,) * 4], schema)
    draw = np.random.default_rng(seed)
    shares = sum(draw.binomial(n, min(1.0, p), size=trials) for n, p in states) / sum(n for n, _ in states)
    return rows.sparkSession.createDataFrame([tuple(round(float(x), 6) for x in (shares.mean(), shares.std(ddof=1), shares.min(), shares.max()))], schema)


def permuted_correlations(rows: DataFrame, axes: Sequence[str], weights: Sequence[float], target: str) -> DataFrame:
    """The correlation of a weighted sum with a target under every order of the axes: one pass, one row per order."""
    sums = {p: sum((F.col(a) * w for a, w in zip(p[1:], weights[1:], strict=True)), F.col(p[0]) * weights[0]) for p in itertools.permutations(axes)}
    wide = rows.agg(*[F.round(F.corr(s, target), 6).alias("-".join(p)) for p, s in sums.items()])
    return wide.unpivot([], ["-".join(p) for p in sums], "axes", "correlation")


def shares_of(counts: DataFrame, size: int, least: int = 1, count: str = "n", name: str = "quota") -> DataFrame:
    """``counts`` with integer shares of ``size`` by largest remainder, at least ``least``, never more than there are.

    Every group gets its share rounded down, or ``least``; what is left goes to the largest
    remainders with rows to give, ties by the group's own columns.  Groups stay in a table.
    """
    keys = [c for c in counts.columns if c != count]
    whole = Window.partitionBy()
    exact = F.lit(float(size)) * F.col(count) / F.sum(count).over(whole)
    first = counts.withColumn("__exact", exact).withColumn("__own", F.least(F.col(count), F.greatest(F.lit(least), F.floor("__exact"))))
    first = first.withColumn("__left", F.lit(size) - F.sum("__own").over(whole)).withColumn("__room", F.col("__own") < F.col(count))
    turn = F.row_number().over(Window.orderBy(F.desc("__room"), F.floor("__exact") - F.col("__exact"), *keys))
    return first.withColumn("__turn", turn).select(*keys, count, (F.col("__own") + (F.col("__room") & (F.col("__turn") <= F.col("__left"))).cast("long")).alias(name))


def seeds(rows: DataFrame, strata: Sequence[str], size: int, identity: str, seed: int = 42) -> DataFrame:
    """A seed sample over strata by largest remainder, in hash order."""
    quota = shares_of(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), size).drop("n").select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], F.col("quota").alias("__quota"))
    ranked = Window.partitionBy(*strata).orderBy(hash_order(identity, seed), identity)
    # No stratum can give more than the whole size: partitions keep that many before strata come together.
    first = rows.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= F.lit(size))
    same = F.lit(True)
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return first.join(quota, same).where("__rank <= __quota").select(*rows.columns)


def floored(rows: DataFrame, group: str, size: int, floor: int, identity: str, seed: int = 42) -> DataFrame:
    """``size`` rows by largest remainder over groups, small groups raised to ``floor``, the largest giving, in hash order.

    What the raised groups need is taken from the others by largest remainder over what they have
    above the floor.
    """
    dealt = shares_of(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), size, least=0)
    whole = Window.partitionBy()
    want = dealt.withColumn("__want", F.greatest("quota", F.least(F.lit(floor), F.col("n"))))
    want = want.withColumn("__need", F.sum(F.col("__want") - F.col("quota")).over(whole)).withColumn("__above", F.greatest(F.lit(0), F.col("quota") - F.lit(floor)))
    exact = F.when(F.sum("__above").over(whole) > 0, F.least(F.col("__need"), F.sum("__above").over(whole)) * F.col("__above") / F.sum("__above").over(whole)).otherwise(0.0)
    given = want.withColumn("__exact", exact).withColumn("__down", F.floor("__exact"))
    given = given.withColumn("__left", F.round(F.sum("__exact").over(whole)) - F.sum("__down").over(whole))
    turn = F.row_number().over(Window.orderBy(F.col("__down") - F.col("__exact"), group))
    quota = given.withColumn("__turn", turn).select(F.col(group).alias("__g"), (F.col("__want") - F.col("__down") - (F.col("__turn") <= F.col("__left")).cast("long")).alias("__quota"))
    ranked = Window.partitionBy(group).orderBy(hash_order(identity, seed), identity)
    first = rows.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= F.lit(size))
    return first.join(quota, F.col(group).eqNullSafe(F.col("__g"))).where("__rank <= __quota").select(*rows.columns)


def constrained(rows: DataFrame, minima: Sequence[tuple[str, int]], identity: str, seed: int = 42) -> DataFrame:
    """Rows that meet minima per value of several columns, one column after the other.

    Each pass counts what earlier ones picked and adds, in hash order, what a value still lacks.
    """
    picked: DataFrame | None = None
    for column, least in minima:
        order = Window.partitionBy(column).orderBy(hash_order(identity, seed), identity)
        free = rows if picked is None else rows.join(picked.select(identity), identity, "left_anti")
        # No value can lack more than the minimum: partitions keep that many before values come together.
        first = free.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= F.lit(least))
        if picked is not None:
            have = picked.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__have"))
            first = first.join(have, F.col(column).eqNullSafe(F.col("__value")), "left").where(F.col("__rank") <= F.lit(least) - F.coalesce("__have", F.lit(0)))
        chosen = materialize(first.select(*rows.columns), "chosen")
        picked = chosen if picked is None else picked.unionByName(chosen)
    return rows.limit(0) if picked is None else picked


def matched_names(left: DataFrame, right: DataFrame, name: str, other: str) -> DataFrame:
    """The catalogue entry of each name: equal, equal but for case, or one inside the other, in this order.

    Works on distinct names against a catalogue, which is a table of parameters; ties go to the first.
    """
    names = left.select(name).where(F.col(name).isNotNull()).distinct()
    listed = F.broadcast(right.select(other).where(F.col(other).isNotNull()).distinct().agg(F.array_sort(F.collect_list(other)).alias("__all")))
    a = F.lower(name)
    order = F.transform("__all", lambda b: F.struct(F.when(b == F.col(name), 0).when(F.lower(b) == a, 1).when(F.contains(a, F.lower(b)) | F.contains(F.lower(b), a), 2).otherwise(3).alias("c"), b.alias("b")))
    best = F.array_min(order)
    return names.join(listed).select(name, F.when(best["c"] < 3, best["b"]).alias(other))

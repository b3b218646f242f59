"""Sampling with quotas, strata and diversity; every order is by a reproducible hash."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import materialize


def hash_order(identity: str, seed: int = 42) -> Column:
    """A reproducible random order that any engine with MD5 gives alike."""
    return F.md5(F.concat(F.col(identity).cast("string"), F.lit(f":{seed}")))


def per_group(df: DataFrame, group: str, quota: Column | int, identity: str, seed: int = 42, most: int | None = None) -> DataFrame:
    """At most ``quota`` rows of every group, without replacement, in hash order.

    A quota that differs by group comes with ``most``, the largest: each partition then keeps no
    more than that of a group before groups come together.
    """
    ranked = Window.partitionBy(group).orderBy(hash_order(identity, seed), identity)
    if not isinstance(quota, int) and most is None:
        raise ValueError("a quota by group needs the largest quota")
    rows = df.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= F.lit(quota if isinstance(quota, int) else most))
    return (rows if isinstance(quota, int) else rows.where(F.col("__rank") <= quota)).drop("__rank")


def ranked_in_groups(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "__rank") -> DataFrame:
    """``df`` with the place of each row in its group and the group's size, however large a group is.

    Rows are range-partitioned by group and order; a row's place is that in its range plus the rows
    of the group in the ranges before.  Only counts per range and group meet.
    """
    keyed = df.withColumns({f"__o{i}": o for i, o in enumerate(order)})
    names = [f"__o{i}" for i in range(len(order))]
    cut = materialize(keyed.repartitionByRange(*groups, *names).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = cut.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*groups)
    before = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(own).alias(f"{name}_of"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy("__part", *groups).orderBy(*names)
    return cut.join(starts, same).withColumn(name, F.row_number().over(inside) + F.col("__start")).select(*df.columns, name, f"{name}_of")


def proportional(df: DataFrame, stratum: str, size: int, order: Sequence[Column | str]) -> DataFrame:
    """``size`` rows with the strata in their proportions: shares rounded half to even, the last stratum takes the rest.

    Within a stratum the first rows by ``order`` are kept.
    """
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.orderBy(stratum)
    shared = counts.withColumn("__total", F.sum("__n").over(Window.partitionBy())).withColumn("__raw", F.rint(F.lit(size) * F.col("__n") / F.col("__total")).cast("long"))
    shared = shared.withColumn("__before", F.coalesce(F.sum("__raw").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__last", F.row_number().over(Window.orderBy(F.desc(stratum))) == 1)
    left = F.greatest(F.lit(0), F.lit(size) - F.col("__before"))
    quotas = shared.select(stratum, F.when(F.col("__total") <= size, F.col("__n")).otherwise(F.least(F.when(F.col("__last"), left).otherwise(F.col("__raw")), F.col("__n"), left)).alias("__quota"))
    ranked = Window.partitionBy(stratum).orderBy(*order)
    return df.join(quotas, stratum).withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= F.lit(size)).where(F.col("__rank") <= F.col("__quota")).select(*df.columns)


def stratified(df: DataFrame, strata: Sequence[str], share: float, identity: str, seed: int = 42) -> DataFrame:
    """Of every stratum its share rounded down, at least one row, in hash order."""
    sized = ranked_in_groups(df, strata, [hash_order(identity, seed), F.col(identity)])
    return sized.where(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__rank_of") * F.lit(share)))).select(*df.columns)


def weighted_tiers(df: DataFrame, tier: str, size: int, weights: dict[int, float], identity: str, seed: int = 42) -> DataFrame:
    """``size`` rows by tier weights, the last tier taking the rest, then filled from whatever is left."""
    names = sorted(weights)
    quota = {t: int(size * weights[t]) for t in names}
    quota[names[-1]] = size - sum(quota[t] for t in names[:-1])
    want = F.lit(0)
    for t, n in quota.items():
        want = F.when(F.col(tier) == t, F.lit(n)).otherwise(want)
    ranked = df.withColumn("__h", hash_order(identity, seed)).withColumn("__rank", F.row_number().over(Window.partitionBy(tier).orderBy("__h", identity)))
    # No tier can give more than all that is asked for.
    filled = ranked.where(F.col("__rank") <= F.lit(size)).withColumn("__own", F.col("__rank") <= want)
    order = filled.orderBy(F.desc("__own"), "__h", identity).limit(size)
    return order.select(*df.columns)


def keep_within(df: DataFrame, limit: float, cost: str, order: Sequence[str], total: str = "spent") -> DataFrame:
    """Rows in order while their running cost stays below the limit, with that cost.

    Costs are summed by ranges of the order; a range starts from the totals before it, so no task
    sees all rows.  Null costs are nothing spent.
    """
    priced = df.withColumn("__cost", F.coalesce(F.col(cost), F.lit(0.0)))
    cut = materialize(priced.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "spent")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__part").agg(F.sum("__cost").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__start"))
    running = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = cut.join(F.broadcast(starts), "__part").withColumn(total, F.sum("__cost").over(running) + F.col("__start"))
    return spent.where(F.col(total) < limit).select(*df.columns, total)


def diverse(df: DataFrame, group: str, features: Sequence[str], priority: str, identity: str, quota: int) -> DataFrame:
    """Per group ``quota`` rows, each the best by priority x (half + half its distance to those chosen).

    Distance is the share of features in which two rows differ; ties go to the smaller id.  Rows of
    equal features and priority differ by their ids alone and are picked in that order, so the
    ``quota`` smallest ids of each such combination are all that can be picked: nothing else is cut.
    """
    alike = Window.partitionBy(*dict.fromkeys([group, *features, "__value"])).orderBy(identity)
    rows = df.select(*dict.fromkeys([group, identity, priority, *features])).withColumn("__value", F.coalesce(F.col(priority).cast("double"), F.lit(0.0)))
    rows = rows.withColumn("__rank", F.row_number().over(alike)).where(F.col("__rank") <= quota).drop("__rank", "__value")
    out = T.StructType([rows.schema[group], rows.schema[identity], T.StructField("pick", T.IntegerType())])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(identity).reset_index(drop=True)
        codes = np.stack([pd.factorize(frame[c], use_na_sentinel=False)[0] for c in features], axis=1)
        value = frame[priority].fillna(0).to_numpy(dtype=float)
        nearest = np.full(len(frame), np.inf)
        free = np.ones(len(frame), dtype=bool)
        picks = []
        for _ in range(min(quota, len(frame))):
            score = value if not picks else value * (0.5 + 0.5 * nearest / len(features))
            i = int(np.argmax(np.where(free, score, -np.inf)))
            picks.append(i)
            free[i] = False
            nearest = np.minimum(nearest, (codes != codes[i]).sum(axis=1))
        return pd.DataFrame({group: frame[group].iloc[picks].to_numpy(), identity: frame[identity].iloc[picks].to_numpy(), "pick": np.arange(1, len(picks) + 1, dtype=np.int32)})

    return rows.groupBy(group).applyInPandas(choose, out)


def facility_location(vectors: DataFrame, vector: str, identity: str, size: int, sigma: float, group_rows: int = 5000) -> DataFrame:
    """``size`` representatives that cover all vectors best under a Gaussian kernel, greedily.

    Equal vectors count with their multiplicity.  Distinct vectors are dealt by hash into groups of
    at most about ``group_rows``; each group picks its own representatives, which then stand for the
    vectors nearest to them, and the picks of all groups are dealt and picked from again until they
    fit one group.  So up to ``group_rows`` distinct vectors are solved by plain greedy, more in
    rounds, with kernels of a fixed size.  Ties go to the smaller id.
    """
    out = T.StructType([vectors.schema[identity], T.StructField("pick", T.IntegerType()), T.StructField("gain", T.DoubleType()), vectors.schema[vector], T.StructField("weight", T.LongType())])
    left = vectors.where(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(identity).alias(identity), F.count(F.lit(1)).alias("weight"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(identity).reset_index(drop=True)
        x = np.stack([np.asarray(v, dtype=float) for v in frame[vector]])
        weight = frame["weight"].to_numpy(dtype=float)
        square = (x * x).sum(axis=1)
        kernel = np.exp(-np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T) / (2 * sigma * sigma))
        covered, picks = np.zeros(len(frame)), []
        # Gains only ever shrink, so one computed earlier bounds what is left of it: most need no second look.
        bounds = [(-round(float(g), 9), i) for i, g in enumerate(kernel @ weight)]
        heapq.heapify(bounds)
        while bounds and len(picks) < size:
            _, i = heapq.heappop(bounds)
            fresh = (-round(float((np.maximum(0, kernel[i] - covered) * weight).sum()), 9), i)
            if bounds and fresh > bounds[0]:
                heapq.heappush(bounds, fresh)
                continue
            picks.append((i, -fresh[0]))
            covered = np.maximum(covered, kernel[i])
        rows = [i for i, _ in picks]
        nearest = np.argmax(kernel[:, rows], axis=1)
        held = np.bincount(nearest, weights=weight, minlength=len(rows)).astype(np.int64)
        return pd.DataFrame({identity: frame[identity].iloc[rows].to_numpy(), "pick": np.arange(1, len(rows) + 1, dtype=np.int32), "gain": [g for _, g in picks], vector: frame[vector].iloc[rows].to_numpy(), "weight": held})

    n = left.count()
    while True:
        groups = max(1, -(-n // group_rows))
        if groups > 1 and size * groups >= n:
            groups = max(1, n // (2 * size))
        picked = left.withColumn("__group", F.pmod(F.xxhash64(identity), F.lit(groups))).groupBy("__group").applyInPandas(choose, out)
        if groups == 1:
            return picked.select(identity, "pick", "gain")
        left = materialize(picked.select(vector, identity, "weight"), "picked")
        n = left.count()

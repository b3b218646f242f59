"""Rank statistics and resampling as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize

#: Bounds of a Poisson(1) variable's distribution in 65,536ths, for weights 0 to 5.
POISSON = (24109, 48219, 60273, 64292, 65296)


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) weight of a uniform 16-bit number, 0 to 5."""
    weight = F.lit(len(POISSON))
    for w in reversed(range(len(POISSON))):
        weight = F.when(u < POISSON[w], w).otherwise(weight)
    return weight


def bucket_of(identity: Column) -> Column:
    """One of 4,096 buckets of an id, by hash."""
    return F.substring(F.md5(identity.cast("string")), 1, 3)


def bootstrap_ratio(rows: DataFrame, identity: str, top: str, bottom: Column | str | None = None, replicates: int = 200, by: str | None = None) -> DataFrame:
    """Mean and the central 95 % of a ratio of sums under resampling of ids, over all rows or by a column.

    Ids are dealt by hash into 4,096 buckets, which are what is resampled: one aggregate over the
    rows gives the sums of each, and every bucket gets, in every replicate, a Poisson weight from a
    hash of its name.  All rows of an id share a bucket, so clusters stay together; no row is copied.
    """
    keys = [by] if by else []
    below = F.lit(1) if bottom is None else F.col(bottom) if isinstance(bottom, str) else bottom
    sums = rows.groupBy(*keys, bucket_of(F.col(identity)).alias("__k")).agg(F.sum(F.col(top).cast("double")).alias("__t"), F.sum(below.cast("double")).alias("__n"))
    drawn = sums.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.conv(F.substring(F.md5(F.concat("__k", F.lit(":"), F.col("__b").cast("string"))), 1, 4), 16, 10).cast("int")
    per = drawn.select(*keys, "__b", "__t", "__n", poisson_weight(u).alias("__w")).groupBy(*keys, "__b").agg(F.try_divide(F.sum(F.col("__t") * F.col("__w")), F.sum(F.col("__n") * F.col("__w"))).alias("p"))
    return per.groupBy(*keys).agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.percentile("p", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("p", F.lit(0.975)), 6).alias("high"))


def bootstrap_share(rows: DataFrame, identity: str, flag: str, replicates: int = 200) -> DataFrame:
    """Mean and the central 95 % of a share under resampling of ids."""
    return bootstrap_ratio(rows, identity, flag, replicates=replicates)


def _cumulated(values: DataFrame, by: str, sums: list[str], slices: int = 64) -> DataFrame:
    """Running sums over distinct values without one task seeing them all.

    Values are cut into ranges; each range is summed on its own and starts from the totals of the
    ranges before it.
    """
    cut = materialize(values.repartitionByRange(slices, by).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(starts), "__part")
    return joined.select(*values.columns, *[(F.sum(c).over(inside) + F.col(f"__{c}")).alias(f"upto_{c}") for c in sums])


def _sides(rows: DataFrame, value: str, first: Column) -> tuple[DataFrame, DataFrame]:
    """Counts of both sides per distinct value, and their totals; names cannot clash with the table's."""
    own = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("__x"), first.alias("__y"))
    counts = own.groupBy("__x").agg(F.count_if(F.col("__y")).alias("__a"), F.count_if(~F.col("__y")).alias("__b"))
    return counts, counts.agg(F.sum("__a").alias("__na"), F.sum("__b").alias("__nb"))


def ks_statistic(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """The largest difference of two distribution functions; null if a side is empty."""
    counts, total = _sides(rows, value, first)
    both = _cumulated(counts, "__x", ["__a", "__b"]).join(F.broadcast(total))
    return both.agg(F.round(F.max(F.abs(F.try_divide(F.col("upto___a"), F.col("__na")) - F.try_divide(F.col("upto___b"), F.col("__nb")))), 6).alias("ks"))


def _average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    counts = rows.groupBy(value).agg(F.sum("__w").alias("__n"))
    return _cumulated(counts, value, ["__n"]).select(value, (F.col("upto___n") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The correlation of average ranks over rows with both values; null without spread."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("__p"), F.col(b).alias("__q")).agg(F.count(F.lit(1)).alias("__w"))
    spread = pairs.join(_average_ranks(pairs, "__p", "__ra"), "__p").join(_average_ranks(pairs, "__q", "__rb"), "__q")
    w, x, y = F.col("__w").cast("double"), F.col("__ra"), F.col("__rb")
    sums = spread.agg((F.sum(w * x) / F.sum(w)).alias("__mx"), (F.sum(w * y) / F.sum(w)).alias("__my"))
    dx, dy = x - F.col("__mx"), y - F.col("__my")
    whole = F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))
    return spread.join(F.broadcast(sums)).agg(F.round(F.try_divide(F.sum(w * dx * dy), whole), 6).alias("rho"))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """The area under the ROC curve by ranks; ties count half; null if a side is empty."""
    counts, total = _sides(rows, score, positive)
    both = _cumulated(counts, "__x", ["__b"]).join(F.broadcast(total))
    won = F.sum(F.col("__a") * (F.col("upto___b") - F.col("__b") / 2))
    return both.agg(F.round(F.try_divide(won, F.first("__na").cast("double") * F.first("__nb")), 6).alias("auc"))

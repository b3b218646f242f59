"""Learned operators: completion of a sparse matrix, threshold and neighbour routers, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import outer_product
from .sampling import ranked_in_groups


def held_out(identity: Column, share: float, seed: int) -> Column:
    """Whether a row belongs to the held-out share, by hash of its identity."""
    u = F.conv(F.substring(F.md5(F.concat(identity, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return u < F.lit(int(share * (1 << 32)))


def _filled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.coalesce(x, F.lit(0.0)))


def complete_matrix(observed: DataFrame, target: DataFrame, sample: str, config: str, label: str, strength: float = 1.0, rounds: int = 50) -> DataFrame:
    """``target`` with ``chance``: logistic regression on all products of sample and configuration features.

    ``strength`` is the inverse weight of the ridge penalty over all rows; features are not scaled.
    Null features count as 0, rows without a label teach nothing, and without any the chance is null.
    """
    def featured(df: DataFrame) -> DataFrame:
        return df.withColumn("__x", array_to_vector(_filled(outer_product(F.col(sample), F.col(config)))))

    train = featured(observed.where(F.col(label).isNotNull())).select(F.col(label).cast("double").alias("label"), F.col("__x").alias("features"))
    rows = train.count()
    if not rows:
        return target.withColumn("chance", F.lit(None).cast("double"))
    model = LogisticRegression(maxIter=rounds, regParam=1.0 / (strength * max(1, rows)), elasticNetParam=0.0, standardization=False).fit(train)
    scored = model.transform(featured(target).withColumnRenamed("__x", "features"))
    return scored.withColumn("chance", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction")


def logistic_router(train: DataFrame, test: DataFrame, features: str, label: str, key: str, rounds: int = 50) -> DataFrame:
    """Multinomial logistic regression on standardised features: key and predicted class.

    Null features count as 0; without training rows every prediction is null.
    """
    train, test = (t.withColumn(features, _filled(F.col(features))) for t in (train.where(F.col(label).isNotNull()), test))
    if train.isEmpty():
        return test.select(key, F.lit(None).cast("int").alias("predicted"))
    scaled = StandardScaler(inputCol="__x", outputCol="features", withMean=True, withStd=True).fit(train.withColumn("__x", array_to_vector(features)))
    model = LogisticRegression(maxIter=rounds, family="multinomial").fit(scaled.transform(train.withColumn("__x", array_to_vector(features))).withColumn("label", F.col(label).cast("double")))
    out = model.transform(scaled.transform(test.withColumn("__x", array_to_vector(features))))
    return out.select(key, F.col("prediction").cast("int").alias("predicted"))


def best_thresholds(rows: DataFrame, score: str, right: Sequence[str], steps: int = 20) -> DataFrame:
    """Two cut points of a score that route best: class 1 below the first, 2 below the second, else 3.

    ``right`` names three boolean columns: would class i be right.  The score is cut into ``steps``
    cells; counts per cell are all that the search over pairs of cuts needs.
    """
    span = rows.agg(F.min(score).alias("low"), F.max(score).alias("high"))
    cell = F.least(F.lit(steps - 1), F.floor((F.col(score) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) * steps)).cast("int")
    cells = rows.where(F.col(score).isNotNull()).join(F.broadcast(span)).groupBy(cell.alias("c")).agg(*[F.sum(F.coalesce(F.col(r), F.lit(False)).cast("long")).alias(f"r{i}") for i, r in enumerate(right)], F.count(F.lit(1)).alias("n"))
    listed = cells.agg(F.collect_list(F.struct("c", "r0", "r1", "r2", "n")).alias("cells"), F.sum("n").alias("n"))
    cuts = listed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(steps))))
    hits = F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + F.when(x["c"] < F.col("i"), x["r0"]).when(x["c"] < F.col("j"), x["r1"]).otherwise(x["r2"]))
    best = cuts.select("i", "j", hits.alias("hits"), "n").orderBy(F.desc("hits"), "i", "j").limit(1).join(F.broadcast(span))
    width = (F.col("high") - F.col("low")) / steps
    return best.select(F.round(F.col("low") + F.col("i") * width, 6).alias("first_cut"), F.round(F.col("low") + F.col("j") * width, 6).alias("second_cut"), F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"))


def mean_baselines(train: DataFrame, test: DataFrame, label: str, by: Sequence[str], identity: str) -> DataFrame:
    """Per test row the mean label of its group in training, for each grouping, else the global mean."""
    value = F.coalesce(F.col(label), F.lit(False)).cast("double")
    whole = train.agg(F.avg(value).alias("global"))
    out = test.join(F.broadcast(whole))
    for c in by:
        out = out.join(train.groupBy(c).agg(F.avg(value).alias(f"by_{c}")), c, "left").withColumn(f"by_{c}", F.coalesce(f"by_{c}", "global"))
    return out.select(identity, label, "global", *[f"by_{c}" for c in by])


def neighbour_router(train: DataFrame, test: DataFrame, found: DataFrame, label: str, cost: str, default: str) -> DataFrame:
    """The label most of a row's neighbours have, the cheapest on a tie; the default without any."""
    votes = found.join(train.select(F.col("id").alias("neighbour_id"), label, cost), "neighbour_id").groupBy("query_id", label).agg(F.count(F.lit(1)).alias("n"), F.min(cost).alias("c"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "c", label))[label].alias("voted"))
    return test.join(best, test["id"] == best["query_id"], "left").select(F.col("id"), F.coalesce("voted", F.lit(default)).alias("predicted"))


def first_correct_budget(matrix: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample and model the smallest budget that was correct, as log(tokens + 1); null without."""
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    return matrix.groupBy(key, "model_name").agg(F.round(F.log1p(F.min(F.when(right, F.col("budget_tokens"))).cast("double")), 6).alias("target"))


def factor_completion(observed: DataFrame, target: DataFrame, label: str, rank: int = 8, rounds: int = 10, seed: int = 42) -> DataFrame:
    """``target`` with ``chance`` from low-rank factors of samples and configurations.

    Ids get dense numbers, since the factorisation takes 31 bits; a sample or configuration that was
    never observed has the mean of the observed labels.
    """
    seen = observed.where(F.col(label).isNotNull())
    # One row per id: its place among all, by ranges of ids, without one task that sees them all.
    numbers = {c: ranked_in_groups(seen.where(F.col(c).isNotNull()).select(c).distinct().withColumn("__all", F.lit(1)), ["__all"], [F.col(c)]).select(F.col(c).alias(f"__id_{c}"), F.col("__rank").cast("int").alias(f"__{c}")) for c in ("sample_id", "config_id")}

    def numbered(df: DataFrame) -> DataFrame:
        for c, ids in numbers.items():
            df = df.join(ids, F.col(c) == F.col(f"__id_{c}"), "left").withColumn(f"__{c}", F.coalesce(f"__{c}", F.lit(-1))).drop(f"__id_{c}")
        return df

    known = numbered(seen).select("__sample_id", "__config_id", F.col(label).cast("float").alias("__y"))
    if known.isEmpty():
        return target.withColumn("chance", F.lit(None).cast("double"))
    mean = known.agg(F.avg("__y").alias("__mean"))
    model = ALS(rank=rank, maxIter=rounds, regParam=0.1, userCol="__sample_id", itemCol="__config_id", ratingCol="__y", coldStartStrategy="nan", seed=seed).fit(known)
    scored = model.transform(numbered(target)).join(F.broadcast(mean))
    chance = F.when(F.isnan("prediction") | F.col("prediction").isNull(), F.col("__mean")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction").cast("double"))))
    return scored.withColumn("chance", chance).select(*target.columns, "chance")


def network_router(train: DataFrame, test: DataFrame, features: str, label: str, key: str, classes: int, hidden: Sequence[int] = (16,), rounds: int = 60, seed: int = 42) -> DataFrame:
    """A feed-forward network on standardised features: key and predicted class."""
    train, test = (t.withColumn("__x", array_to_vector(_filled(F.col(features)))) for t in (train.where(F.col(label).isNotNull()), test))
    first = train.select(F.size(features).alias("n")).first()
    if first is None:
        return test.select(key, F.lit(None).cast("int").alias("predicted"))
    scaled = StandardScaler(inputCol="__x", outputCol="features", withMean=True, withStd=True).fit(train)
    net = MultilayerPerceptronClassifier(layers=[first["n"], *hidden, classes], maxIter=rounds, seed=seed)
    model = net.fit(scaled.transform(train).withColumn("label", F.col(label).cast("double")))
    return model.transform(scaled.transform(test)).select(key, F.col("prediction").cast("int").alias("predicted"))


def route_by_chance(scored: DataFrame, threshold: float = 0.5, key: str = "sample_id") -> DataFrame:
    """The cheapest configuration with at least the threshold's chance, else the cheapest of all."""
    good = F.min(F.when(F.col("chance") >= threshold, F.struct("cost", "config_id")))["config_id"]
    return scored.groupBy(key).agg(F.coalesce(good, F.min(F.struct("cost", "config_id"))["config_id"]).alias("config_id"))


def with_before(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``value`` beside that of the row before it."""
    return df.withColumn(f"{value}_before", F.lag(value).over(Window.partitionBy(key).orderBy(order)))

"""Queries that train routers and completion models and study how they carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluation, learn, routers, statistics
from ..sources.tables import table
from ..workspace import materialize
from .base import matrix, notes, query, samples
from .feature_queries import _FLAGS, router_rows
from .learn_queries import _key
from .stat_queries import nearest_vectors

S = SparkSession
WIDTH = 48


def training(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The matrix, prices, routable samples, and one training row per sample that was tried."""
    m = matrix(spark, d).select("sample_id", "config_id", "is_correct", "cost", "tier", "model_name", "budget_tokens")
    priced = evaluation.prices(m)
    per = evaluation.routable(m, priced)
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    tops = m.join(F.broadcast(evaluation.cheapest_of_tiers(priced)))
    by = tops.groupBy("sample_id").agg(*[F.bool_or(right & (F.col("config_id") == F.col(f"t{t}"))).alias(f"right_{t}") for t in (1, 2, 3)], *[F.bool_or(right & (F.col("tier") == t)).alias(f"any_{t}") for t in (1, 2, 3)], F.count_distinct("config_id").alias("__tried"))
    whole = table(spark, d, "model_configs").agg(F.count_distinct("config_id").alias("__whole"))
    rows = router_rows(spark, d).join(by, "sample_id").join(per.select("sample_id", F.col("best_config").alias("target")), "sample_id").join(F.broadcast(whole))
    rows = rows.withColumn("seen", F.col("__tried") / F.col("__whole")).withColumn("full", F.col("__tried") >= F.col("__whole"))
    return m, priced, per, rows.drop("__tried", "__whole")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = learn.held_out(F.col("sample_id"), 0.2, 42)
    rows = materialize(rows, "training")
    return rows.where(~out), rows.where(out)


def _told(fitted: list[routers.Router], test: DataFrame, m: DataFrame, per: DataFrame, priced: DataFrame) -> DataFrame:
    held = per.join(test.select("sample_id"), "sample_id", "left_semi")
    parts = [evaluation.metrics(evaluation.judged(r.predict(test), m, held, priced), priced, r.name) for r in fitted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def learned_router_metrics(spark: S, d: str) -> DataFrame:
    """Threshold, logistic and learned cascade routers on a held-out fifth of the samples."""
    m, priced, per, rows = training(spark, d)
    train, test = _split(rows)
    configs = [r["config_id"] for r in table(spark, d, "model_configs").where("config_id is not null").select("config_id").distinct().orderBy("config_id").collect()]
    fitted = [r.fit(train) for r in (routers.ThresholdRouter(priced), routers.LogisticConfigRouter(configs), routers.LearnedCascade(priced))]
    return _told(fitted, test, m, per, priced)


@query()
def network_router_metrics(spark: S, d: str) -> DataFrame:
    """The cost-sensitive network and the network of two phases on a held-out fifth of the samples."""
    m, priced, per, rows = training(spark, d)
    configs = table(spark, d, "model_configs").where("config_id is not null and model_name is not null")
    listed = configs.select("config_id", "model_name", F.coalesce("budget_tokens", F.lit(0)).alias("budget")).distinct().orderBy("config_id").collect()
    models = sorted({r["model_name"] for r in listed}) or [""]
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    first = m.groupBy("sample_id", "model_name").agg(F.min(F.when(right, F.col("budget_tokens"))).alias("b")).groupBy("sample_id").agg(*[F.coalesce(F.max(F.when(F.col("model_name") == x, F.log1p(F.col("b").cast("double")))), F.lit(float("nan"))).alias(f"b{i}") for i, x in enumerate(models)])
    owner = F.broadcast(configs.select(F.col("config_id").alias("target"), F.col("model_name").alias("__model")).distinct())
    at = (F.array_position(F.array(*map(F.lit, models)).cast("array<string>"), F.col("__model")) - 1).cast("int")
    rows = rows.join(first.select("sample_id", F.array(*[F.col(f"b{i}") for i in range(len(models))]).cast("array<double>").alias("budget_targets")), "sample_id").join(owner, "target", "left").withColumn("model", F.coalesce(at, F.lit(-1))).drop("__model")
    train, test = _split(rows)
    price_of = {r["config_id"]: r["price"] for r in priced.collect()}
    config_of = {(r["model_name"], r["budget"]): r["config_id"] for r in reversed(listed)}
    fitted = [r.fit(train) for r in (routers.CostSensitiveNetwork(price_of, WIDTH), routers.TwoPhaseNetwork(models, config_of, WIDTH))]
    return _told(fitted, test, m, per, priced)


# Completion studies


def _entries(spark: S, d: str) -> DataFrame:
    """Matrix entries with the features that hold-out studies use: x of the sample, c of the configuration."""
    s = samples(spark, d, "task_type", "source_dataset", *_FLAGS).join(notes(spark, d, "tier", "vds", "rds", "ses").withColumnRenamed("tier", "grade"), "sample_id", "left")
    x = vectors.short_sample(F.col("grade"), [F.col(f) for f in _FLAGS], F.upper(F.trim("task_type")))
    s = s.select("sample_id", F.concat(F.array(F.lit(1.0)), x).alias("x"), "grade", F.regexp_replace(F.lower("source_dataset"), r"[\s\-_]+", "").alias("source"))
    m = matrix(spark, d).select("sample_id", "config_id", "is_correct", "cost", "tier", "rate", "budget_tokens", "provider", "model_name")
    names = [r[0] for r in table(spark, d, "model_configs").where("provider is not null").select("provider").distinct().orderBy("provider").collect()]
    c = F.concat(F.array(F.lit(1.0)), vectors.scaled_config(F.col("tier"), F.col("rate"), F.col("budget_tokens"), F.col("provider"), names))
    return materialize(m.withColumn("c", c).join(s, "sample_id").select("sample_id", "config_id", "model_name", "source", "grade", "is_correct", "cost", "x", "c"), "entries")


def _aucs(scored: DataFrame, by: str) -> DataFrame:
    """AUC per value of a column by average ranks inside it; null where a value lacks one class.

    Chances are rounded to 4 places, so the ranks are running sums over at most 10,001 values per group.
    """
    from pyspark.sql import Window

    cells = scored.where(F.col("is_correct").isNotNull() & F.col(by).isNotNull()).groupBy(by, F.round("chance", 4).alias("p")).agg(F.count_if("is_correct").alias("a"), F.count_if(~F.col("is_correct")).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy(by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = cells.withColumn("w", F.col("a") * (below + F.col("b") / 2))
    return won.groupBy(by).agg(F.sum("a").alias("right"), F.sum("b").alias("wrong"), F.round(F.try_divide(F.sum("w"), F.sum("a").cast("double") * F.sum("b")), 6).alias("auc"))


@query()
def source_holdout(spark: S, d: str) -> DataFrame:
    """Training without three sources: AUC on each, on each model, and how often the routes agree with the cheapest correct ones."""
    rows = _entries(spark, d)
    top = [r["source"] for r in rows.where("source is not null").groupBy("source").agg(F.count_distinct("sample_id").alias("n")).orderBy(F.desc("n"), "source").limit(3).collect()]
    out = F.coalesce(F.col("source").isin(top or [""]), F.lit(False))
    scored = materialize(learn.complete_matrix(rows.where(~out), rows.where(out), "x", "c", "is_correct").select("sample_id", "config_id", "source", "model_name", "is_correct", "cost", "chance"), "scored")
    part = [_aucs(scored, c).select(F.lit(k).alias("figure"), F.col(c).alias("name"), F.col("auc").alias("value")) for k, c in (("source_auc", "source"), ("model_auc", "model_name"))]
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    want = scored.groupBy("sample_id").agg(F.min(F.when(right, F.struct("cost", "config_id")))["config_id"].alias("want"))
    agree = learn.route_by_chance(scored).join(want, "sample_id").where("want is not null").agg(F.round(F.avg((F.col("config_id") == F.col("want")).cast("double")), 6).alias("value"))
    return part[0].unionByName(part[1]).unionByName(agree.select(F.lit("agreement").alias("figure"), F.lit("").alias("name"), "value"))


@query()
def row_extension(spark: S, d: str) -> DataFrame:
    """AUC on held-out sources when training gets k of their samples, mean and deviation over seeds."""
    rows = _entries(spark, d)
    top = [r["source"] for r in rows.where("source is not null").groupBy("source").agg(F.count_distinct("sample_id").alias("n")).orderBy(F.desc("n"), "source").limit(2).collect()]
    out = F.coalesce(F.col("source").isin(top or [""]), F.lit(False))
    held, base = rows.where(out), rows.where(~out)
    part = None
    for k in (0, 50):
        for seed in (1, 2):
            extra = held.select("sample_id").distinct().orderBy(F.md5(F.concat("sample_id", F.lit(f":{seed}")))).limit(k) if k else None
            train = base if extra is None else base.unionByName(held.join(extra, "sample_id", "left_semi"))
            test = held if extra is None else held.join(extra, "sample_id", "left_anti")
            scored = learn.complete_matrix(train, test, "x", "c", "is_correct").where("is_correct is not null").withColumn("chance", F.round("chance", 9))
            one = statistics.auc(scored, "chance", F.col("is_correct")).select(F.lit(k).alias("k"), "auc")
            part = one if part is None else part.unionByName(one)
            if not k:
                break
    return part.groupBy("k").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("auc"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("auc"), F.lit(0.0)), 6).alias("deviation"))


@query()
def external_model(spark: S, d: str) -> DataFrame:
    """The last model by name as one that training never saw: AUC and accuracy by grade of the samples."""
    rows = _entries(spark, d)
    last = rows.agg(F.max("model_name").alias("__last"))
    marked = rows.join(F.broadcast(last)).withColumn("__out", F.col("model_name") == F.col("__last"))
    scored = learn.complete_matrix(marked.where(~F.col("__out")), marked.where("__out"), "x", "c", "is_correct").where("is_correct is not null and grade in (1, 2, 3)")
    scored = materialize(scored.select("grade", "is_correct", "chance"), "scored")
    hits = scored.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("chance") >= 0.5) == F.col("is_correct")).cast("double")), 6).alias("accuracy"))
    return hits.join(_aucs(scored, "grade").select("grade", "auc"), "grade", "left")


@query()
def factor_sweep(spark: S, d: str) -> DataFrame:
    """Accuracy of routes from low-rank factors over ranks and thresholds."""
    m = matrix(spark, d).select("sample_id", "config_id", "is_correct", "cost")
    out = learn.held_out(_key(), 0.2, 42)
    truth = m.where(out).select("sample_id", "config_id", F.coalesce("is_correct", F.lit(False)).alias("hit"))
    part = None
    for rank in (4, 8):
        scored = materialize(learn.factor_completion(m.where(~out), m.where(out), "is_correct", rank=rank, rounds=5), "scored")
        for threshold in (0.4, 0.5, 0.6):
            one = learn.route_by_chance(scored, threshold).join(truth, ["sample_id", "config_id"]).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))
            one = one.select(F.lit(rank).alias("rank"), F.lit(threshold).alias("threshold"), "accuracy")
            part = one if part is None else part.unionByName(one)
    return part


@query("""SELECT k, accuracy, row_number() OVER (ORDER BY accuracy DESC, k) AS place FROM (SELECT k, round(avg(CASE WHEN label = target THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
 SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY n DESC, label) AS r FROM (SELECT k, id, target, label, count(*) AS n FROM (
 SELECT a.vec_id AS id, a.label AS target, b.label AS label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY 1, 2, 3, 4)) WHERE r = 1 GROUP BY 1)""", base=False)
def neighbour_count(spark: S, d: str) -> DataFrame:
    """Which number of neighbours votes best, over the stated query set."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = nearest_vectors(spark, d).select("query_id", "neighbour_id", "rank")
    votes = near.join(labels.select(F.col("vec_id").alias("neighbour_id"), "label"), "neighbour_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("target")), "query_id")
    return routers.choose_k(votes.select(F.col("query_id").alias("id"), "rank", "label", "target"), (1, 3, 5)).withColumn("place", F.col("place").cast("long"))

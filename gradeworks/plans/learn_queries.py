"""Queries over learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..operators import learn, routing, statistics
from ..sources.tables import table
from ..workspace import materialize
from .base import matrix, notes, query, samples

S = SparkSession


def _featured(spark: S, d: str) -> DataFrame:
    s = samples(spark, d, "has_table", "has_chart", "has_figure", "num_pages", "task_type").select("sample_id", F.array(F.lit(1.0), *[features.flag(c).cast("double") for c in ("has_table", "has_chart", "has_figure")], F.least(F.coalesce("num_pages", F.lit(1)), F.lit(20)) / 20.0).alias("s"), features.one_hot(F.upper(F.trim("task_type")), features.TASKS).alias("t"))
    n = notes(spark, d, "composite").select("sample_id", F.coalesce("composite", F.lit(2.0)).alias("composite"))
    m = matrix(spark, d)
    config = F.array(F.lit(1.0), F.col("tier") / 3.0, F.log1p("rate"), F.log1p(F.col("budget_tokens").cast("double")) / 10.0)
    j = m.join(s, "sample_id").join(n, "sample_id", "left")
    return j.select("sample_id", "config_id", "is_correct", "cost", F.concat("s", "t", F.array(F.coalesce("composite", F.lit(2.0)) / 4.0)).alias("x"), config.alias("c"))


def _key():
    return F.concat("sample_id", F.lit("|"), "config_id")


@query()
def completion_auc(spark: S, d: str) -> DataFrame:
    """AUC of completed entries on a held-out fifth of the matrix."""
    rows = _featured(spark, d)
    out = learn.held_out(_key(), 0.2, 42)
    scored = learn.complete_matrix(rows.where(~out), rows.where(out), "x", "c", "is_correct")
    return statistics.auc(scored.where("is_correct is not null").withColumn("chance", F.round("chance", 9)), "chance", F.col("is_correct"))


@query()
def completion_routes(spark: S, d: str) -> DataFrame:
    """The cheapest configuration that completion deems right, for held-out samples."""
    rows = _featured(spark, d)
    out = learn.held_out(F.col("sample_id"), 0.2, 42)
    scored = learn.complete_matrix(rows.where(~out), rows.where(out), "x", "c", "is_correct")
    return learn.route_by_chance(scored)


@query()
def factor_routes(spark: S, d: str) -> DataFrame:
    """The cheapest configuration that low-rank factors deem right, for held-out entries."""
    m = matrix(spark, d)
    out = learn.held_out(_key(), 0.2, 42)
    return learn.route_by_chance(learn.factor_completion(m.where(~out), m.where(out), "is_correct"))


@query()
def learning_curve(spark: S, d: str) -> DataFrame:
    """AUC on one held-out fifth after training on a tenth, a third and all of the rest."""
    rows = _featured(spark, d)
    out, part = learn.held_out(_key(), 0.2, 42), None
    for share in (0.1, 0.33, 1.0):
        train = rows.where(~out & learn.held_out(_key(), share, 7)) if share < 1 else rows.where(~out)
        scored = learn.complete_matrix(train, rows.where(out), "x", "c", "is_correct")
        one = statistics.auc(scored.where("is_correct is not null").withColumn("chance", F.round("chance", 9)), "chance", F.col("is_correct")).select(F.lit(share).alias("share"), "auc")
        part = one if part is None else part.unionByName(one)
    return part


@query()
def model_holdout_auc(spark: S, d: str) -> DataFrame:
    """AUC over the configurations of each model that training never saw; then mean, least and most.

    A model without both right and wrong answers has a null AUC, which the summary leaves out.
    """
    rows = materialize(_featured(spark, d), "featured")
    configs = table(spark, d, "model_configs").where("model_name is not null and config_id is not null")
    owned: dict[str, list[str]] = {}
    for r in configs.select("model_name", "config_id").distinct().collect():
        owned.setdefault(r["model_name"], []).append(r["config_id"])
    part = spark.createDataFrame([], "model_name string, auc double")
    for name in sorted(owned):
        out = F.col("config_id").isin(owned[name])
        scored = learn.complete_matrix(rows.where(~out), rows.where(out), "x", "c", "is_correct").where("is_correct is not null").withColumn("chance", F.round("chance", 9))
        part = part.unionByName(statistics.auc(scored, "chance", F.col("is_correct")).select(F.lit(name).alias("model_name"), "auc"))
    aucs = materialize(part, "aucs")
    whole = aucs.agg(F.avg("auc").alias("mean"), F.min("auc").alias("least"), F.max("auc").alias("most"))
    summary = whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.lit(None).cast("string").alias("model_name"), F.round(c, 6).alias("auc")) for c in ("mean", "least", "most")])))
    return aucs.select(F.lit("model").alias("figure"), "model_name", "auc").unionByName(summary)


_HELD = "CAST(('0x' || substr(md5(sample_id || '|' || config_id || ':42'), 1, 8)) AS BIGINT) < 858993459"
_BASE = f""", tr AS (SELECT * FROM matrix WHERE NOT ({_HELD})), te AS (SELECT * FROM matrix WHERE {_HELD})"""


@query(_BASE + """SELECT te.result_id, te.is_correct, round((SELECT avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) FROM tr), 6) AS global,
 round(coalesce(a.m, (SELECT avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) FROM tr)), 6) AS by_sample_id, round(coalesce(b.m, (SELECT avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) FROM tr)), 6) AS by_config_id
 FROM te LEFT JOIN (SELECT sample_id, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS m FROM tr GROUP BY 1) a USING (sample_id)
 LEFT JOIN (SELECT config_id, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS m FROM tr GROUP BY 1) b USING (config_id)""")
def mean_baselines(spark: S, d: str) -> DataFrame:
    m = matrix(spark, d)
    out = learn.held_out(_key(), 0.2, 42)
    found = learn.mean_baselines(m.where(~out), m.where(out), "is_correct", ["sample_id", "config_id"], "result_id")
    return found.select("result_id", "is_correct", *[F.round(c, 6).alias(c) for c in ("global", "by_sample_id", "by_config_id")])


@query(""", p AS (SELECT m.sample_id, coalesce(bool_or(is_correct AND m.tier = 1), false) AS t1, coalesce(bool_or(is_correct AND m.tier = 2), false) AS t2, coalesce(bool_or(is_correct AND m.tier = 3), false) AS t3, max(n.composite) AS s FROM matrix m JOIN notes n USING (sample_id) GROUP BY 1),
 span AS (SELECT min(s) AS low, max(s) AS high FROM p), c AS (SELECT least(19, CAST(floor((s - low) / greatest(high - low, 1e-12) * 20) AS INT)) AS c, t1, t2, t3 FROM p, span WHERE s IS NOT NULL),
 cuts AS (SELECT i, j FROM (SELECT unnest(range(21)) AS i) a JOIN (SELECT unnest(range(21)) AS j) b ON j >= i),
 hits AS (SELECT i, j, sum(CASE WHEN c < i THEN t1::INT WHEN c < j THEN t2::INT ELSE t3::INT END) AS h, count(*) AS n FROM c, cuts GROUP BY 1, 2)
SELECT round(low + i * ((high - low) / 20), 6) AS first_cut, round(low + j * ((high - low) / 20), 6) AS second_cut, round(h / CAST(n AS DOUBLE), 6) AS accuracy FROM hits, span ORDER BY h DESC, i, j LIMIT 1""")
def threshold_router(spark: S, d: str) -> DataFrame:
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    per = matrix(spark, d).groupBy("sample_id").agg(*[F.bool_or(right & (F.col("tier") == t)).alias(f"t{t}") for t in (1, 2, 3)])
    return learn.best_thresholds(per.join(notes(spark, d, "composite").select("sample_id", "composite"), "sample_id"), "composite", ["t1", "t2", "t3"])


@query()
def logistic_tier_router(spark: S, d: str) -> DataFrame:
    label = routing.cascade(matrix(spark, d)).where("tier is not null").select("sample_id", (F.col("tier") - 1).alias("label"))
    vector = F.array(*[features.flag(c).cast("double") for c in ("has_table", "has_chart", "has_figure")], F.coalesce("num_pages", F.lit(1)).cast("double"))
    rows = samples(spark, d, "has_table", "has_chart", "has_figure", "num_pages").select("sample_id", vector.alias("x")).join(label, "sample_id")
    out = learn.held_out(F.col("sample_id"), 0.2, 42)
    return learn.logistic_router(rows.where(~out), rows.where(out), "x", "label", "sample_id")


@query()
def network_tier_router(spark: S, d: str) -> DataFrame:
    label = routing.cascade(matrix(spark, d)).where("tier is not null").select("sample_id", (F.col("tier") - 1).alias("label"))
    vector = F.array(*[features.flag(c).cast("double") for c in ("has_table", "has_chart", "has_figure")], F.coalesce("num_pages", F.lit(1)).cast("double"))
    rows = samples(spark, d, "has_table", "has_chart", "has_figure", "num_pages").select("sample_id", vector.alias("x")).join(label, "sample_id")
    out = learn.held_out(F.col("sample_id"), 0.2, 42)
    return learn.network_router(rows.where(~out), rows.where(out), "x", "label", "sample_id", classes=3)


@query("SELECT sample_id, model_name, round(ln(1 + min(budget_tokens) FILTER (WHERE is_correct)), 6) AS target FROM matrix GROUP BY 1, 2")
def budget_targets(spark: S, d: str) -> DataFrame:
    return learn.first_correct_budget(matrix(spark, d))


@query("SELECT sample_id, CAST(('0x' || substr(md5(sample_id || ':42'), 1, 8)) AS BIGINT) < 858993459 AS held_out FROM samples")
def sample_holdout(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "ingested_at").select("sample_id", learn.held_out(F.col("sample_id"), 0.2, 42).alias("held_out"))


@query("SELECT sample_id, config_id, max(is_correct::INT) AS entry FROM matrix WHERE is_correct IS NOT NULL GROUP BY 1, 2")
def pivoted_matrix(spark: S, d: str) -> DataFrame:
    """The wide matrix of all configurations read back as entries."""
    wide = whole_matrix(spark, d).drop("observed")
    names = [c for c in wide.columns if c != "sample_id"]
    each = [F.struct(F.lit(c).alias("config_id"), F.col(f"`{c}`").alias("entry")) for c in names] or [F.struct(F.lit("").alias("config_id"), F.lit(None).cast("int").alias("entry"))]
    return wide.select("sample_id", F.inline(F.array(*each))).where("entry is not null")


@query()
def whole_matrix(spark: S, d: str) -> DataFrame:
    """Per sample a column for every configuration of model_configs, null where it was not observed."""
    names = [r[0] for r in table(spark, d, "model_configs").where("config_id is not null").select("config_id").distinct().orderBy("config_id").collect()]
    return matrix(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("observed"), *[F.max(F.when(F.col("config_id") == n, F.col("is_correct").cast("int"))).alias(n) for n in names])

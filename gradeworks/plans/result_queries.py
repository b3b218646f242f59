"""Queries over results: merges, work lists, reports and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name, query_form, text_key
from ..operators import results, routing
from ..sources.tables import table
from .base import matrix, notes, query, runs, samples

S = SparkSession


@query("SELECT sample_id, config_id, result_id, is_correct FROM pairs")
def merge_last_results(spark: S, d: str) -> DataFrame:
    r = runs(spark, d, "sample_id", "config_id", "is_correct", "ingested_at").select("sample_id", "config_id", "result_id", "is_correct", "ingested_at")
    return results.last_by(r, ["sample_id", "config_id"], ["ingested_at", "result_id"]).select("sample_id", "config_id", "result_id", "is_correct")


@query("SELECT result_id, sample_id, config_id FROM eval_results QUALIFY row_number() OVER (PARTITION BY sample_id, config_id ORDER BY ingested_at, result_id) = 1", base=False)
def first_result_per_pair(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "eval_results").select("sample_id", "config_id", "ingested_at", "result_id")
    return results.first_by(r, ["sample_id", "config_id"], ["ingested_at", "result_id"]).select("result_id", "sample_id", "config_id")


@query("SELECT s.sample_id, c.config_id FROM (SELECT DISTINCT sample_id FROM bench_samples) s CROSS JOIN model_configs c WHERE NOT EXISTS (SELECT 1 FROM eval_results e WHERE e.sample_id = s.sample_id AND e.config_id = c.config_id)", base=False)
def pending_work(spark: S, d: str) -> DataFrame:
    return results.pending(table(spark, d, "bench_samples"), table(spark, d, "model_configs"), table(spark, d, "eval_results"))


@query("SELECT DISTINCT sample_id FROM bench_samples WHERE sample_id NOT IN (SELECT sample_id FROM judge_scores WHERE sample_id IS NOT NULL)", base=False)
def unjudged_samples(spark: S, d: str) -> DataFrame:
    return table(spark, d, "bench_samples").select("sample_id").distinct().join(table(spark, d, "judge_scores"), "sample_id", "left_anti")


@query("SELECT DISTINCT sample_id FROM eval_results WHERE sample_id NOT IN (SELECT sample_id FROM bench_samples)", base=False)
def withdrawn_samples(spark: S, d: str) -> DataFrame:
    return table(spark, d, "eval_results").select("sample_id").distinct().join(table(spark, d, "bench_samples"), "sample_id", "left_anti")


@query("""SELECT DISTINCT sample_id FROM (SELECT sample_id FROM bench_samples UNION SELECT sample_id FROM eval_results UNION SELECT sample_id FROM judge_scores)""", base=False)
def key_union(spark: S, d: str) -> DataFrame:
    return table(spark, d, "bench_samples").select("sample_id").union(table(spark, d, "eval_results").select("sample_id")).union(table(spark, d, "judge_scores").select("sample_id")).distinct()


@query("SELECT sample_id FROM bench_samples INTERSECT SELECT sample_id FROM complexity_annotations", base=False)
def key_intersection(spark: S, d: str) -> DataFrame:
    return table(spark, d, "bench_samples").select("sample_id").intersect(table(spark, d, "complexity_annotations").select("sample_id"))


@query("SELECT sample_id FROM bench_samples EXCEPT SELECT sample_id FROM complexity_annotations", base=False)
def key_difference(spark: S, d: str) -> DataFrame:
    return table(spark, d, "bench_samples").select("sample_id").subtract(table(spark, d, "complexity_annotations").select("sample_id"))


@query(""", verdict AS (SELECT sample_id, max(tier) AS v FROM notes WHERE tier IN (1,2,3) GROUP BY 1),
judged AS (SELECT sample_id, CAST(max(vds) AS INT) AS v FROM judge_scores WHERE vds BETWEEN 1 AND 4 GROUP BY 1),
raw AS (SELECT sample_id, max(num_pages) AS v FROM samples GROUP BY 1)
SELECT k.sample_id, coalesce(a.v, b.v, c.v, 0) AS value,
  CASE WHEN a.v IS NOT NULL THEN 'verdict' WHEN b.v IS NOT NULL THEN 'judge' WHEN c.v IS NOT NULL THEN 'raw' ELSE 'default' END AS signal
FROM (SELECT sample_id FROM verdict UNION SELECT sample_id FROM judged UNION SELECT sample_id FROM raw) k
LEFT JOIN verdict a USING (sample_id) LEFT JOIN judged b USING (sample_id) LEFT JOIN raw c USING (sample_id)""")
def signal_precedence(spark: S, d: str) -> DataFrame:
    verdict = notes(spark, d, "tier").where("tier in (1, 2, 3)").select("sample_id", "tier")
    judged = table(spark, d, "judge_scores").where("vds between 1 and 4").groupBy("sample_id").agg(F.max("vds").alias("vds"))
    raw = samples(spark, d, "num_pages").select("sample_id", "num_pages")
    return results.first_signal([("verdict", verdict, "tier"), ("judge", judged, "vds"), ("raw", raw, "num_pages")], ["sample_id"], F.lit(0))


@query("SELECT p.sample_id, p.config_id, coalesce(s.task_type, '') AS task_type, coalesce(s.num_pages, 0) AS num_pages FROM pairs p LEFT JOIN samples s USING (sample_id)")
def lookup_with_defaults(spark: S, d: str) -> DataFrame:
    r = merge_last_results(spark, d).select("sample_id", "config_id")
    return results.with_defaults(r, samples(spark, d, "task_type", "num_pages"), "sample_id", {"task_type": "", "num_pages": 0})


@query("SELECT s.sample_id, coalesce(n.composite, CAST(s.num_pages AS DOUBLE)) AS composite FROM samples s JOIN notes n USING (sample_id)")
def overlay_scores(spark: S, d: str) -> DataFrame:
    base = samples(spark, d, "num_pages").select("sample_id", F.col("num_pages").cast("double").alias("composite"))
    return results.overlay(base, notes(spark, d, "composite").select("sample_id", "composite"), "sample_id")


_KEY = r"md5(trim(regexp_replace(regexp_replace(lower(coalesce(query,'')), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\s+', ' ', 'g')))"


@query(f"SELECT sample_id, {_KEY} AS text_key FROM samples")
def text_keys(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "query").select("sample_id", text_key(F.col("query")).alias("text_key"))


_RANK = "CASE regexp_replace(lower(source_dataset), '[\\s\\-_]+', '', 'g') WHEN 'docvqa' THEN 3 WHEN 'infographicvqa' THEN 2 WHEN 'chartqa' THEN 1 ELSE 0 END"


def _priority():
    name = canonical_name(F.col("source_dataset"))
    return F.when(name == "docvqa", 3).when(name == "infographicvqa", 2).when(name == "chartqa", 1).otherwise(0)


@query(f""", keyed AS (SELECT *, {_KEY} AS k, {_RANK} AS p FROM samples)
SELECT sample_id, n_rows FROM (SELECT sample_id, count(*) OVER (PARTITION BY k) AS n_rows, row_number() OVER (PARTITION BY k ORDER BY p DESC, sample_id) AS r FROM keyed) WHERE r = 1""")
def dedup_by_priority(spark: S, d: str) -> DataFrame:
    return results.priority_dedup(samples(spark, d, "query", "source_dataset"), [text_key(F.col("query"))], _priority(), ["sample_id"], "sample_id")


@query(f""", keyed AS (SELECT *, {_KEY} AS k, {_RANK} AS p, coalesce(source_dataset, '') AS label FROM samples),
won AS (SELECT k, label AS winner, sample_id AS wid FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY p DESC, sample_id) = 1)
SELECT w.winner, x.label AS loser, count(*) AS n FROM keyed x JOIN won w USING (k) WHERE x.sample_id <> w.wid GROUP BY ALL""")
def dedup_losses(spark: S, d: str) -> DataFrame:
    return results.duplicate_counts(samples(spark, d, "query", "source_dataset"), [text_key(F.col("query"))], _priority(), ["sample_id"], "source_dataset")


@query(f""", keyed AS (SELECT sample_id, {_KEY} AS k, {_RANK} AS p, CASE WHEN trim(image_path) <> '' THEN md5(lower(trim(image_path))) END AS i FROM samples),
 grouped AS (SELECT *, coalesce(i, min(i) OVER (PARTITION BY k)) AS g FROM keyed)
SELECT sample_id, n_rows FROM (SELECT sample_id, count(*) OVER (PARTITION BY k, g) AS n_rows, row_number() OVER (PARTITION BY k, g ORDER BY p DESC, sample_id) AS r FROM grouped) WHERE r = 1""")
def dedup_by_two_signals(spark: S, d: str) -> DataFrame:
    s = samples(spark, d, "query", "source_dataset", "image_path")
    return results.two_signal_dedup(s, text_key(F.col("query")), results.image_key(F.col("image_path")), _priority(), "sample_id")


@query(r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(trim(coalesce(query,''))) < 5 THEN 'query_too_short'
 WHEN trim(coalesce(gt_answer,'')) = '' THEN 'answer_empty' WHEN trim(query) = trim(gt_answer) THEN 'query_equals_answer'
 WHEN lower(trim(gt_answer)) IN ('n/a','none','unknown','null','unanswerable','not stated') THEN 'uninformative_answer' ELSE 'kept' END AS reason FROM (
 SELECT regexp_replace(query, '^\s+|\s+$', '', 'g') AS query, regexp_replace(gt_answer, '^\s+|\s+$', '', 'g') AS gt_answer FROM samples)) GROUP BY 1""")
def quality_gate(spark: S, d: str) -> DataFrame:
    from ..functions.text import strip

    q, a = strip(F.coalesce("query", F.lit(""))), strip(F.coalesce("gt_answer", F.lit("")))
    reason = F.when(F.length(q) < 5, "query_too_short").when(a == "", "answer_empty").when(q == a, "query_equals_answer").when(F.lower(a).isin("n/a", "none", "unknown", "null", "unanswerable", "not stated"), "uninformative_answer").otherwise("kept")
    return samples(spark, d, "query", "gt_answer").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT result_id, unnest(list_filter([CASE WHEN regexp_matches(coalesce(predicted_answer,''), '^[ \t\r\n]*$') THEN 'empty_answer' END,
 CASE WHEN coalesce(reasoning_tokens,0) = 0 AND right(config_id,2) IN ('B2','B3') THEN 'no_reasoning' END,
 CASE WHEN len(string_split(predicted_answer,' ')) > 50 THEN 'long_answer' END,
 CASE WHEN total_cost_usd > 0.2 THEN 'cost_out_of_range' END, CASE WHEN latency_ms > 90000 THEN 'slow' END], lambda x: x IS NOT NULL)) AS flag
FROM runs WHERE result_type = 'observed' AND NOT coalesce(isnan(total_cost_usd), false)""")
def record_checks(spark: S, d: str) -> DataFrame:
    r = runs(spark, d, "result_type", "total_cost_usd", "predicted_answer", "reasoning_tokens", "config_id", "latency_ms").where((F.col("result_type") == "observed") & ~F.coalesce(F.isnan("total_cost_usd"), F.lit(False)))
    flags = F.array_compact(F.array(
        F.when(F.coalesce("predicted_answer", F.lit("")).rlike(r"^[ \t\r\n]*$"), "empty_answer"),
        F.when((F.coalesce("reasoning_tokens", F.lit(0)) == 0) & F.right("config_id", F.lit(2)).isin("B2", "B3"), "no_reasoning"),
        F.when(F.size(F.split("predicted_answer", " ")) > 50, "long_answer"),
        F.when(F.col("total_cost_usd") > 0.2, "cost_out_of_range"),
        F.when(F.col("latency_ms") > 90000, "slow"),
    ))
    return r.select("result_id", F.explode(flags).alias("flag"))


@query("SELECT CASE WHEN in_anchor_set THEN 'anchor' WHEN in_validation_set THEN 'validation' ELSE 'remaining' END AS split, count(*) AS n FROM samples GROUP BY 1")
def split_sizes(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "in_anchor_set", "in_validation_set").groupBy(F.when(F.col("in_anchor_set"), "anchor").when(F.col("in_validation_set"), "validation").otherwise("remaining").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sample_id FROM matrix GROUP BY 1 HAVING count(*) >= 12")
def well_covered_samples(spark: S, d: str) -> DataFrame:
    return matrix(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 12").select("sample_id")


# Reports


@query("SELECT upper(trim(task_type)) AS task, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM samples GROUP BY 1")
def task_overview(spark: S, d: str) -> DataFrame:
    g = samples(spark, d, "task_type").groupBy(F.upper(F.trim("task_type")).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""SELECT upper(trim(task_type)) AS task, n.tier AS tier, count(*) AS n, grouping(upper(trim(task_type))) * 2 + grouping(n.tier) AS level
FROM samples s JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3) AND task_type IS NOT NULL GROUP BY CUBE (upper(trim(task_type)), n.tier)""")
def task_by_tier_cube(spark: S, d: str) -> DataFrame:
    j = samples(spark, d, "task_type").where("task_type is not null").join(notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", "tier"), "sample_id")
    return j.withColumn("task", F.upper(F.trim("task_type"))).cube("task", "tier").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT upper(trim(task_type)) AS task, count(*) FILTER (WHERE n.tier = 1) AS tier_1, count(*) FILTER (WHERE n.tier = 2) AS tier_2, count(*) FILTER (WHERE n.tier = 3) AS tier_3
FROM samples s JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3) AND task_type IS NOT NULL GROUP BY 1""")
def task_by_tier_pivot(spark: S, d: str) -> DataFrame:
    j = samples(spark, d, "task_type").where("task_type is not null").join(notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", "tier"), "sample_id")
    p = j.groupBy(F.upper(F.trim("task_type")).alias("task")).pivot("tier", [1, 2, 3]).count()
    return p.select("task", *[F.coalesce(F.col(str(t)), F.lit(0)).alias(f"tier_{t}") for t in (1, 2, 3)])


@query("""SELECT model_name, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
 round(sum(cost) / nullif(count(*) FILTER (WHERE is_correct), 0), 8) AS cost_per_correct FROM matrix GROUP BY 1""")
def model_accuracy(spark: S, d: str) -> DataFrame:
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    return matrix(spark, d).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"), F.round(F.try_divide(F.sum("cost"), F.count_if(right)), 8).alias("cost_per_correct"))


_TASKS = ", acc AS (SELECT model_name, upper(trim(task_type)) AS task, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS a FROM matrix JOIN samples USING (sample_id) WHERE task_type IS NOT NULL GROUP BY 1, 2)"


def _task_accuracy(spark: S, d: str) -> DataFrame:
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    tasks = samples(spark, d, "task_type").where("task_type is not null").select("sample_id", F.upper(F.trim("task_type")).alias("task"))
    return matrix(spark, d).join(tasks, "sample_id").groupBy("model_name", "task").agg(F.avg(right).alias("a"))


@query(_TASKS + "SELECT model_name, round(max(a) - min(a), 6) AS spread, round(max(a), 6) AS best, round(min(a), 6) AS worst, first(task ORDER BY a DESC, task) AS best_task FROM acc GROUP BY 1")
def accuracy_spread_by_task(spark: S, d: str) -> DataFrame:
    return _task_accuracy(spark, d).groupBy("model_name").agg(F.round(F.max("a") - F.min("a"), 6).alias("spread"), F.round(F.max("a"), 6).alias("best"), F.round(F.min("a"), 6).alias("worst"), F.min(F.struct((-F.col("a")).alias("o"), "task"))["task"].alias("best_task"))


@query(""", acc AS (SELECT model_name, n.tier AS t, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS a FROM matrix m JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3) GROUP BY 1, 2),
 wide AS (SELECT model_name, max(a) FILTER (WHERE t = 1) AS a1, max(a) FILTER (WHERE t = 3) AS a3 FROM acc GROUP BY 1)
SELECT model_name, round(a1, 6) AS easy, round(a3, 6) AS hard, CASE WHEN a1 - a3 > .15 THEN 'strong' WHEN a1 - a3 > .07 THEN 'moderate' ELSE 'weak' END AS drop_class FROM wide""")
def accuracy_drop_by_tier(spark: S, d: str) -> DataFrame:
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    grade = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", F.col("tier").alias("t"))
    wide = matrix(spark, d).join(grade, "sample_id").groupBy("model_name").pivot("t", [1, 3]).agg(F.avg(right))
    gap = F.col("1") - F.col("3")
    return wide.select("model_name", F.round("1", 6).alias("easy"), F.round("3", 6).alias("hard"), F.when(gap > 0.15, "strong").when(gap > 0.07, "moderate").otherwise("weak").alias("drop_class"))


#: The budget levels in order.
LEVELS = ("B0", "B1", "B2", "B3")


@query(""", acc AS (SELECT model_name, budget_level, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS a FROM matrix GROUP BY 1, 2)
SELECT a.model_name, a.budget_level, round(a.a, 6) AS accuracy, round(a.a - b.a, 6) AS gain FROM acc a LEFT JOIN acc b ON b.model_name = a.model_name AND b.budget_level = 'B' || (CAST(substr(a.budget_level, 2) AS INT) - 1)""")
def gain_by_budget(spark: S, d: str) -> DataFrame:
    """Accuracy of every budget level and its gain over the level below; null where that was not tried."""
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    wide = matrix(spark, d).groupBy("model_name").pivot("budget_level", list(LEVELS)).agg(F.avg(right))
    each = [F.struct(F.lit(x).alias("budget_level"), F.col(x).alias("a"), (F.col(LEVELS[i - 1]) if i else F.lit(None).cast("double")).alias("b")) for i, x in enumerate(LEVELS)]
    return wide.select("model_name", F.inline(F.array(*each))).where("a is not null").select("model_name", "budget_level", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - F.col("b"), 6).alias("gain"))


@query(""", acc AS (SELECT model_name, upper(trim(task_type)) AS task, n.tier AS t, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS a
 FROM matrix JOIN samples USING (sample_id) JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3) AND task_type IS NOT NULL GROUP BY ALL)
SELECT model_name, task, round(avg(a), 6) AS mean_of_means, count(*) AS tiers FROM acc GROUP BY 1, 2""")
def mean_of_tier_means(spark: S, d: str) -> DataFrame:
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    tasks = samples(spark, d, "task_type").where("task_type is not null").select("sample_id", F.upper(F.trim("task_type")).alias("task"))
    grade = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", F.col("tier").alias("t"))
    acc = matrix(spark, d).join(tasks, "sample_id").join(grade, "sample_id").groupBy("model_name", "task", "t").agg(F.avg(right).alias("a"))
    return acc.groupBy("model_name", "task").agg(F.round(F.avg("a"), 6).alias("mean_of_means"), F.count(F.lit(1)).alias("tiers"))


_POINTS = ", points AS (SELECT config_id, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(cost), 8) AS cost FROM matrix GROUP BY 1)"


def points(spark: S, d: str) -> DataFrame:
    """Accuracy and mean cost of every configuration: as many rows as there are configurations."""
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    return matrix(spark, d).groupBy("config_id").agg(F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("cost"), 8).alias("cost"))


@query(_POINTS + "SELECT config_id, accuracy, cost FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.cost < p.cost AND q.accuracy > p.accuracy)")
def strict_frontier(spark: S, d: str) -> DataFrame:
    return routing.strict_frontier(points(spark, d)).select("config_id", "accuracy", "cost")


@query(_POINTS + "SELECT config_id, accuracy, cost, cost < coalesce(min(cost) OVER (ORDER BY accuracy DESC, cost, config_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS on_frontier FROM points")
def running_frontier(spark: S, d: str) -> DataFrame:
    return routing.running_frontier(points(spark, d)).select("config_id", "accuracy", "cost", "on_frontier")


# Routing

def _labels(order: str) -> str:
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, {order}) AS r FROM matrix)
SELECT sample_id, max(config_id) FILTER (WHERE r = 1 AND is_correct) AS config_id, count(*) FILTER (WHERE is_correct) AS n_correct, count(*) AS n_configs FROM ranked GROUP BY 1"""


@query(_labels("tier, rate, model_name, budget_level, config_id"))
def cheapest_by_tier_rate(spark: S, d: str) -> DataFrame:
    return routing.cheapest(matrix(spark, d), ["tier", "rate", "model_name", "budget_level"])


@query(_labels("tier, cost, config_id"))
def cheapest_by_tier_cost(spark: S, d: str) -> DataFrame:
    return routing.cheapest(matrix(spark, d), ["tier", "cost"])


@query(_labels("cost, config_id"))
def cheapest_by_cost(spark: S, d: str) -> DataFrame:
    return routing.cheapest(matrix(spark, d), ["cost"])


@query(_labels("rate * (budget_tokens + 1), config_id"))
def cheapest_by_proxy(spark: S, d: str) -> DataFrame:
    return routing.cheapest(matrix(spark, d), [F.col("rate") * (F.col("budget_tokens") + 1)])


@query(_labels("rate, config_id, budget_level"))
def cheapest_by_rate(spark: S, d: str) -> DataFrame:
    return routing.cheapest(matrix(spark, d), ["rate"])


@query(""", ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM matrix),
 best AS (SELECT * FROM ranked WHERE r = 1)
SELECT b.sample_id, CASE WHEN b.is_correct THEN b.config_id END AS config_id, CASE WHEN b.is_correct THEN b.tier END AS tier,
 CAST((SELECT count(*) FROM matrix m WHERE m.sample_id = b.sample_id AND (NOT coalesce(b.is_correct, false) OR m.tier <= b.tier)) AS INT) AS calls FROM best b""")
def cascade_labels(spark: S, d: str) -> DataFrame:
    return routing.cascade(matrix(spark, d))


@query(""", open AS (SELECT m.* FROM matrix m JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3) AND m.tier <= n.tier + 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM open)
SELECT sample_id, CASE WHEN is_correct THEN config_id END AS config_id, CASE WHEN is_correct THEN tier END AS tier FROM ranked WHERE r = 1""")
def cascade_with_stop(spark: S, d: str) -> DataFrame:
    grade = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", F.col("tier").alias("stop"))
    return routing.cascade(matrix(spark, d).join(grade, "sample_id"), F.col("stop")).select("sample_id", "config_id", "tier")


_DOMINANCE = """, v AS (SELECT a.sample_id, count(*) AS pairs, count(*) FILTER (WHERE NOT coalesce(b.is_correct, false)) AS violated
 FROM matrix a JOIN matrix b ON a.sample_id = b.sample_id AND a.tier < b.tier WHERE a.is_correct GROUP BY 1)"""


@query(_DOMINANCE + "SELECT m.sample_id, coalesce(v.pairs, 0) AS pairs, coalesce(v.violated, 0) AS violated FROM (SELECT DISTINCT sample_id FROM matrix) m LEFT JOIN v USING (sample_id)")
def dominance_pairs(spark: S, d: str) -> DataFrame:
    return routing.violations(matrix(spark, d))


_WILSON = """round(greatest(0, (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS low,
 round(least(1, (p + 1.96*1.96/(2*n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS high"""


@query(_DOMINANCE + f", t AS (SELECT CAST(sum(violated) AS BIGINT) AS violated, CAST(sum(pairs) AS BIGINT) AS pairs, sum(violated) * 1.0 / sum(pairs) AS p, CAST(sum(pairs) AS DOUBLE) AS n FROM v) SELECT violated, pairs, round(p, 6) AS rate, {_WILSON} FROM t")
def dominance_rate(spark: S, d: str) -> DataFrame:
    return routing.violation_rate(matrix(spark, d))


@query(_DOMINANCE + f", t AS (SELECT n.tier AS stratum, CAST(sum(violated) AS BIGINT) AS violated, CAST(sum(pairs) AS BIGINT) AS pairs, sum(violated) * 1.0 / sum(pairs) AS p, CAST(sum(pairs) AS DOUBLE) AS n FROM v JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3) GROUP BY 1) SELECT stratum, violated, pairs, round(p, 6) AS rate, {_WILSON} FROM t")
def dominance_rate_by_tier(spark: S, d: str) -> DataFrame:
    grade = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", F.col("tier").alias("stratum"))
    return routing.violation_rate(matrix(spark, d).join(grade, "sample_id"), by="stratum")


_PICK = ", pick AS (SELECT sample_id, config_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM matrix) WHERE r = 1 AND is_correct)"


@query(_PICK + ", pc AS (SELECT p.sample_id, m.cost FROM pick p JOIN matrix m USING (sample_id, config_id)) SELECT m.sample_id, count(*) AS cheaper, count(*) FILTER (WHERE is_correct) AS cheaper_correct FROM matrix m JOIN pc USING (sample_id) WHERE m.cost < pc.cost GROUP BY 1")
def cheaper_than_cascade(spark: S, d: str) -> DataFrame:
    m = matrix(spark, d)
    return routing.cheaper_than_pick(m, routing.cascade(m).where("config_id is not null"))


_REGRET = _PICK + ", reg AS (SELECT m.sample_id, greatest(0, max(m.cost) FILTER (WHERE m.config_id = p.config_id) - min(m.cost) FILTER (WHERE is_correct)) AS regret FROM matrix m JOIN pick p USING (sample_id) GROUP BY 1)"


@query(_REGRET + "SELECT sample_id, round(regret, 9) AS regret FROM reg")
def cost_regret(spark: S, d: str) -> DataFrame:
    m = matrix(spark, d)
    return routing.regret(m, routing.cascade(m).where("config_id is not null")).withColumn("regret", F.round("regret", 9))


@query(_REGRET + "SELECT count(*) AS n, round(avg(regret * 1e6), 4) AS mean, round(max(regret * 1e6), 4) AS largest, round(quantile_cont(regret * 1e6, 0.95), 4) AS p95, count(*) FILTER (WHERE regret = 0) AS zero, round(avg(CASE WHEN regret = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM reg")
def cost_regret_summary(spark: S, d: str) -> DataFrame:
    m = matrix(spark, d)
    return routing.regret_summary(routing.regret(m, routing.cascade(m).where("config_id is not null")))


@query(""", cum AS (SELECT sample_id, is_correct, sum(cost) OVER (PARTITION BY sample_id ORDER BY cost, config_id ROWS UNBOUNDED PRECEDING) AS s FROM matrix)
SELECT sample_id, round(coalesce(min(s) FILTER (WHERE is_correct), max(s)), 8) AS spent FROM cum GROUP BY 1""")
def spent_until_right(spark: S, d: str) -> DataFrame:
    return routing.spent_until_right(matrix(spark, d)).withColumn("spent", F.round("spent", 8))


_MODE = ", lab AS (SELECT sample_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM matrix) WHERE r = 1 AND is_correct), keyed AS (SELECT l.tier AS target, upper(trim(s.task_type)) AS task FROM lab l JOIN samples s USING (sample_id) WHERE task_type IS NOT NULL)"


@query(_MODE + "SELECT task, target FROM (SELECT task, target, row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, target) AS r FROM keyed GROUP BY 1, 2) WHERE r = 1")
def tier_mode_map(spark: S, d: str) -> DataFrame:
    lab = routing.cascade(matrix(spark, d)).where("tier is not null").select("sample_id", F.col("tier").alias("target"))
    tasks = samples(spark, d, "task_type").where("task_type is not null").select("sample_id", F.upper(F.trim("task_type")).alias("task"))
    return routing.mode_map(lab.join(tasks, "sample_id"), ["task"], "target")


@query(""", lab AS (SELECT sample_id, model_name FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM matrix) WHERE r = 1 AND is_correct)
SELECT model_name, count(*) AS changed, round(count(*) * 1.0 / (SELECT count(*) FROM lab), 6) AS churn FROM lab GROUP BY 1""")
def label_churn(spark: S, d: str) -> DataFrame:
    return routing.churn(matrix(spark, d))


@query("""SELECT provider, round(1 - count(*) * 1.0 / (count(DISTINCT sample_id) * count(DISTINCT config_id)), 6) AS saved FROM matrix GROUP BY 1""")
def calls_saved(spark: S, d: str) -> DataFrame:
    return matrix(spark, d).groupBy("provider").agg(F.round(1 - F.count(F.lit(1)) / (F.count_distinct("sample_id") * F.count_distinct("config_id")), 6).alias("saved"))


@query("""SELECT config_id, n, round(worst, 6) AS accuracy, top_share > .4 AND n >= 100 AS one_answer FROM (
 SELECT config_id, CAST(sum(c) AS BIGINT) AS n, sum(k) * 1.0 / sum(c) AS worst, max(c) * 1.0 / sum(c) AS top_share FROM (
 SELECT config_id, predicted_answer, count(*) AS c, count(*) FILTER (WHERE is_correct) AS k FROM runs WHERE predicted_answer IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""")
def batch_checks(spark: S, d: str) -> DataFrame:
    right = F.count_if(F.coalesce("is_correct", F.lit(False)))
    per = runs(spark, d, "predicted_answer", "config_id", "is_correct").where("predicted_answer is not null").groupBy("config_id", "predicted_answer").agg(F.count(F.lit(1)).alias("c"), right.alias("k"))
    g = per.groupBy("config_id").agg(F.sum("c").alias("n"), (F.sum("k") / F.sum("c")).alias("a"), (F.max("c") / F.sum("c")).alias("top"))
    return g.select("config_id", "n", F.round("a", 6).alias("accuracy"), ((F.col("top") > 0.4) & (F.col("n") >= 100)).alias("one_answer"))


@query("SELECT sample_id, count(DISTINCT model_name) AS models FROM matrix GROUP BY 1 HAVING count(DISTINCT model_name) >= 5 AND NOT bool_or(coalesce(is_correct, false))")
def samples_all_wrong(spark: S, d: str) -> DataFrame:
    g = matrix(spark, d).groupBy("sample_id").agg(F.count_distinct("model_name").alias("models"), F.bool_or(F.coalesce("is_correct", F.lit(False))).alias("any"))
    return g.where("models >= 5 and not any").select("sample_id", "models")


_RATED = "SELECT judge_id, sample_id, unnest(['vds', 'rds', 'ses']) AS axis, unnest([vds, rds, ses]) AS score FROM judge_scores"


@query(f"SELECT judge_id, axis, count(*) AS n, count(DISTINCT sample_id) AS samples, round(avg(score), 6) AS mean_score FROM ({_RATED}) WHERE score BETWEEN 1 AND 4 GROUP BY GROUPING SETS ((judge_id, axis), (axis), ())", base=False)
def judge_summary(spark: S, d: str) -> DataFrame:
    """Ratings of every judge on every axis, of each axis, and of all."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("score")) for a in ("vds", "rds", "ses")])).alias("x")
    long = table(spark, d, "judge_scores").select("judge_id", "sample_id", axes).select("judge_id", "sample_id", "x.*").where("score between 1 and 4")
    return long.groupingSets([["judge_id", "axis"], ["axis"], []], "judge_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("samples"), F.round(F.avg("score"), 6).alias("mean_score"))

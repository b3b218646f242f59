"""Queries that evaluate routers and sum up studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, routing, statistics
from ..sources.tables import table
from .base import matrix, notes, query, samples
from .feature_queries import _PROBED, probe_outcomes
from .result_queries import _TASKS, _task_accuracy
from .stat_queries import _WEIGHT
from .study_queries import _ends

S = SparkSession

_PRICES = """, prices AS (SELECT config_id, min(tier) AS tier, round(avg(cost), 8) AS price FROM matrix GROUP BY 1),
 uni AS (SELECT m.sample_id, bool_or(coalesce(is_correct, false)) AS routable, arg_min(config_id, (price, config_id)) FILTER (WHERE is_correct) AS best_config, min(price) FILTER (WHERE is_correct) AS best_price FROM matrix m JOIN prices USING (config_id) GROUP BY 1),
 tops AS (SELECT arg_min(config_id, (price, config_id)) AS cheapest, arg_min(config_id, (-price, config_id)) AS dearest, max(price) AS top,
  arg_min(config_id, (price, config_id)) FILTER (WHERE tier = 1) AS t1, arg_min(config_id, (price, config_id)) FILTER (WHERE tier = 2) AS t2, arg_min(config_id, (price, config_id)) FILTER (WHERE tier = 3) AS t3 FROM prices)"""
_ROUTES = """, routes AS (SELECT 'cheapest' AS router, sample_id, (SELECT cheapest FROM tops) AS config_id FROM uni
 UNION ALL SELECT 'dearest', sample_id, (SELECT dearest FROM tops) FROM uni
 UNION ALL SELECT 'random', sample_id, list_extract((SELECT list(config_id ORDER BY config_id) FROM prices), CAST(CAST(('0x' || substr(md5(sample_id || ':42'), 1, 8)) AS BIGINT) % (SELECT count(*) FROM prices) AS INT) + 1) FROM uni
 UNION ALL SELECT 'oracle', u.sample_id, coalesce(u.best_config, CASE n.tier WHEN 1 THEN (SELECT t1 FROM tops) WHEN 2 THEN (SELECT t2 FROM tops) WHEN 3 THEN (SELECT t3 FROM tops) END, (SELECT cheapest FROM tops)) FROM uni u LEFT JOIN notes n USING (sample_id)
 UNION ALL SELECT 'tier', u.sample_id, coalesce(CASE n.tier WHEN 1 THEN (SELECT t1 FROM tops) WHEN 2 THEN (SELECT t2 FROM tops) WHEN 3 THEN (SELECT t3 FROM tops) END, (SELECT cheapest FROM tops)) FROM uni u LEFT JOIN notes n USING (sample_id)),
 judged AS (SELECT r.router, u.sample_id, r.config_id, u.routable, u.best_price, p.price, coalesce(m.is_correct, false) AS correct FROM uni u JOIN routes r USING (sample_id) LEFT JOIN prices p USING (config_id) LEFT JOIN matrix m ON m.sample_id = u.sample_id AND m.config_id = r.config_id)"""


def _routes(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    m = matrix(spark, d).select("sample_id", "config_id", "is_correct", "cost", "tier")
    priced = evaluation.prices(m)
    per = evaluation.routable(m, priced)
    tiers = per.select("sample_id").join(notes(spark, d, "tier"), "sample_id", "left").select("sample_id", "tier")
    routes = {k: evaluation.static_routes(per, priced, k) for k in ("cheapest", "dearest", "random")}
    routes |= {"oracle": evaluation.oracle_routes(per, priced, tiers), "tier": evaluation.tier_routes(tiers, priced)}
    return m, priced, per, routes


@query(
    _PRICES
    + _ROUTES
    + """, s AS (SELECT router, count(*) AS n, count(*) FILTER (WHERE correct) AS k, count(*) FILTER (WHERE routable) AS nr, count(*) FILTER (WHERE routable AND correct) AS kr, sum(price) AS c,
 coalesce(sum(price) FILTER (WHERE routable), 0) AS paid, coalesce(sum(best_price) FILTER (WHERE routable), 0) AS best, (SELECT top FROM tops) AS top FROM judged GROUP BY 1)
SELECT router, n AS n_total, k AS n_correct, nr AS n_routable, round(k * 1.0 / n, 6) AS accuracy, round(CASE WHEN nr = 0 THEN 0 ELSE kr * 1.0 / nr END, 6) AS accuracy_routable, round(c, 6) AS total_cost, round(c / n, 8) AS avg_cost,
 round(c / nullif(k, 0), 8) AS cost_per_correct, round(paid, 6) AS total_cost_routable, round(CASE WHEN nr * top > best THEN least(100.0, greatest(0.0, 100 * (nr * top - paid) / (nr * top - best))) ELSE 0.0 END, 4) AS oracle_efficiency FROM s"""
)
def router_metrics(spark: S, d: str) -> DataFrame:
    """The plain routers and the oracle: always the cheapest or dearest, at random, by tier."""
    m, priced, per, routes = _routes(spark, d)
    parts = [evaluation.judged(r, m, per, priced).withColumn("router", F.lit(name)) for name, r in routes.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return evaluation.metrics(rows.withColumnRenamed("router", "__router"), priced, "", ["__router"]).drop("router").withColumnRenamed("__router", "router")


@query(
    _PRICES
    + _ROUTES
    + """, g AS (SELECT j.*, CAST(n.tier AS VARCHAR) AS tier, upper(trim(s.task_type)) AS task FROM judged j LEFT JOIN notes n USING (sample_id) LEFT JOIN samples s USING (sample_id) WHERE router = 'tier'),
 dom AS (SELECT 'tier' AS kind, unnest(['1', '2', '3']) AS value UNION ALL SELECT 'task', unnest(['T1', 'T2', 'T3', 'T4', 'T5', 'T6'])),
 a AS (SELECT 'tier' AS kind, tier AS value, correct, price FROM g UNION ALL SELECT 'task', task, correct, price FROM g)
SELECT dom.kind, dom.value, count(a.price) AS n_samples, round(coalesce(avg(CASE WHEN a.correct THEN 1.0 WHEN a.correct IS NOT NULL THEN 0.0 END), 0), 6) AS accuracy, round(coalesce(avg(a.price), 0), 8) AS avg_cost FROM dom LEFT JOIN a USING (kind, value) GROUP BY 1, 2"""
)
def router_breakdown(spark: S, d: str) -> DataFrame:
    """Accuracy and cost of routing by tier, for each tier and each task."""
    m, priced, per, routes = _routes(spark, d)
    rows = evaluation.judged(routes["tier"], m, per, priced)
    tiers = notes(spark, d, "tier").select("sample_id", F.col("tier").cast("string").alias("value"))
    tasks = samples(spark, d, "task_type").select("sample_id", F.upper(F.trim("task_type")).alias("value"))
    one = evaluation.breakdown(rows, tiers, "value", ("1", "2", "3")).withColumn("kind", F.lit("tier"))
    return one.unionByName(evaluation.breakdown(rows, tasks, "value", ("T1", "T2", "T3", "T4", "T5", "T6")).withColumn("kind", F.lit("task")))


_LABELS = """, lab AS (SELECT sample_id, CASE WHEN is_correct THEN tier END AS target FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM matrix) WHERE r = 1),
 rows AS (SELECT l.sample_id, l.target, n.tier, upper(trim(s.task_type)) AS task, coalesce(s.in_anchor_set, false) AS anchor, coalesce(s.in_validation_set, false) AS valid FROM lab l JOIN samples s USING (sample_id) JOIN notes n USING (sample_id) WHERE n.tier IN (1, 2, 3)),
 m1 AS (SELECT tier, target FROM (SELECT tier, target, row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, target) AS r FROM rows WHERE anchor AND target IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
 m2 AS (SELECT tier, task, target FROM (SELECT tier, task, target, row_number() OVER (PARTITION BY tier, task ORDER BY count(*) DESC, target) AS r FROM rows WHERE anchor AND target IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1),
 told AS (SELECT v.*, coalesce(m1.target, 2) AS p1, coalesce(m2.target, 2) AS p2 FROM rows v LEFT JOIN m1 ON m1.tier = v.tier LEFT JOIN m2 ON m2.tier = v.tier AND m2.task IS NOT DISTINCT FROM v.task WHERE v.valid)"""


def _mode_rows(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lab = routing.cascade(matrix(spark, d)).select("sample_id", F.col("tier").alias("target"))
    s = samples(spark, d, "task_type", "in_anchor_set", "in_validation_set")
    rows = lab.join(s, "sample_id").join(notes(spark, d, "tier").where("tier in (1, 2, 3)").select("sample_id", "tier"), "sample_id")
    rows = rows.select("sample_id", "target", "tier", F.upper(F.trim("task_type")).alias("task"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_anchor_set", "in_validation_set")])
    anchor, valid = rows.where("in_anchor_set"), rows.where("in_validation_set").select("sample_id", "target", "tier", "task")
    one = evaluation.mode_routes(valid, routing.mode_map(anchor, ["tier"], "target"), ["tier"], "target")
    two = evaluation.mode_routes(valid, routing.mode_map(anchor, ["tier", "task"], "target"), ["tier", "task"], "target")
    return valid, one, two


@query(_LABELS + " SELECT sample_id, p1 AS by_tier, coalesce(p1 = target, false) AS tier_right, p2 AS by_tier_task, coalesce(p2 = target, false) AS tier_task_right FROM told")
def mode_predictions(spark: S, d: str) -> DataFrame:
    """The tier that samples of the same grade, and of the same grade and task, need most often."""
    _, one, two = _mode_rows(spark, d)
    return one.select("sample_id", F.col("predicted").alias("by_tier"), F.col("right").alias("tier_right")).join(two.select("sample_id", F.col("predicted").alias("by_tier_task"), F.col("right").alias("tier_task_right")), "sample_id")


@query(
    _PRICES
    + _ROUTES
    + _LABELS.replace(", lab", ", lab", 1)
    + """, a AS (SELECT count(*) AS n, avg(CASE WHEN target IS NOT NULL THEN 1.0 ELSE 0.0 END) AS oracle, avg(CASE WHEN p1 = target THEN 1.0 ELSE 0.0 END) AS by_tier, avg(CASE WHEN p2 = target THEN 1.0 ELSE 0.0 END) AS by_both,
  avg(CASE WHEN j.correct THEN 1.0 ELSE 0.0 END) AS router FROM told JOIN judged j USING (sample_id) WHERE j.router = 'tier')
SELECT n, round(oracle, 6) AS oracle, round(router, 6) AS router, round(by_tier, 6) AS tier_only, round(by_both, 6) AS tier_task, round(100 * (oracle - router), 2) AS gap_total, round(100 * (1 - oracle), 2) AS unroutable,
 round(100 * (oracle - by_tier), 2) AS gap_tier_signal, round(100 * (by_tier - by_both), 2) AS gap_task_marginal, round(100 * (by_both - router), 2) AS gap_residual FROM a"""
)
def gap_decomposition(spark: S, d: str) -> DataFrame:
    """What lies between the oracle and routing by tier, on validation samples, in percentage points."""
    m, priced, per, routes = _routes(spark, d)
    valid, one, two = _mode_rows(spark, d)
    router = evaluation.judged(routes["tier"], m, per, priced).select("sample_id", "correct")
    rows = one.select("sample_id", "target", F.col("right").alias("r1")).join(two.select("sample_id", F.col("right").alias("r2")), "sample_id").join(router, "sample_id")
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("target").isNotNull().cast("double")).alias("o"), F.avg(F.col("r1").cast("double")).alias("a"), F.avg(F.col("r2").cast("double")).alias("b"), F.avg(F.col("correct").cast("double")).alias("c"))
    o, a1, b, c = (F.col(x) for x in "oabc")
    points = {"gap_total": o - c, "unroutable": 1 - o, "gap_tier_signal": o - a1, "gap_task_marginal": a1 - b, "gap_residual": b - c}
    return a.select("n", *[F.round(x, 6).alias(n) for x, n in ((o, "oracle"), (c, "router"), (a1, "tier_only"), (b, "tier_task"))], *[F.round(100 * x, 2).alias(n) for n, x in points.items()])


_MODEL_TIER = ", tiers AS (SELECT model_name, min(ascii(tier) - 64) AS tier FROM model_configs GROUP BY 1)"


def _model_tiers(spark: S, d: str) -> DataFrame:
    return table(spark, d, "model_configs").groupBy("model_name").agg(F.min(F.ascii("tier") - 64).alias("tier"))


@query(
    _TASKS
    + _MODEL_TIER
    + """, t AS (SELECT task, first(model_name ORDER BY a DESC, model_name) AS best_model, first(model_name ORDER BY a, model_name) AS worst_model, max(a) - min(a) AS s,
 coalesce(avg(a) FILTER (WHERE tier = 3), 0) - coalesce(avg(a) FILTER (WHERE tier = 1), 0) AS g FROM acc JOIN tiers USING (model_name) GROUP BY 1)
SELECT task, best_model, worst_model, round(s, 6) AS spread, round(g, 6) AS gap, CASE WHEN s < 0.05 THEN 'tier A' WHEN g > 0.10 THEN 'tier C' WHEN g > 0.05 THEN 'tier B or C' ELSE 'tier B' END AS advice FROM t"""
)
def routing_recommendations(spark: S, d: str) -> DataFrame:
    return evaluation.recommendations(_task_accuracy(spark, d), _model_tiers(spark, d))


@query(
    _TASKS
    + _MODEL_TIER
    + """, b AS (SELECT model_name, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE budget_level = 'B3') - avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE budget_level = 'B0') AS gain FROM matrix GROUP BY 1),
 f AS (SELECT task, avg(a) FILTER (WHERE tier = 3) - avg(a) FILTER (WHERE tier = 1) AS gap FROM acc JOIN tiers USING (model_name) GROUP BY 1),
 k AS (SELECT upper(trim(task_type)) AS task, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS a FROM matrix JOIN samples USING (sample_id) WHERE task_type IS NOT NULL GROUP BY 1)
SELECT 'calls' AS figure, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM matrix UNION ALL SELECT 'cost', '', round(sum(cost), 4) FROM matrix
UNION ALL SELECT 'reasoning_gain', model_name, round(gain, 6) FROM b WHERE gain > 0.03 UNION ALL SELECT 'frontier_gap', task, round(gap, 6) FROM f WHERE gap > 0.10
UNION ALL SELECT 'difficulty_rank', task, CAST(rank() OVER (ORDER BY round(a, 9), task) AS DOUBLE) FROM k"""
)
def evaluation_summary(spark: S, d: str) -> DataFrame:
    """Totals, models that gain by reasoning, tasks where dear models pay, and tasks from the hardest on."""
    from pyspark.sql import Window

    m = matrix(spark, d).select("sample_id", "model_name", "budget_level", "is_correct", "cost")
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    whole = m.agg(F.count(F.lit(1)).cast("double").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))
    totals = whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.lit("").alias("name"), F.coalesce(F.col(c), F.lit(0.0)).alias("value")) for c in ("calls", "cost")])))
    gain = m.groupBy("model_name").agg((F.avg(F.when(F.col("budget_level") == "B3", right)) - F.avg(F.when(F.col("budget_level") == "B0", right))).alias("g")).where("g > 0.03").select(F.lit("reasoning_gain").alias("figure"), F.col("model_name").alias("name"), F.round("g", 6).alias("value"))
    acc = _task_accuracy(spark, d).join(F.broadcast(_model_tiers(spark, d)), "model_name").groupBy("task").agg((F.avg(F.when(F.col("tier") == 3, F.col("a"))) - F.avg(F.when(F.col("tier") == 1, F.col("a")))).alias("g"))
    gap = acc.where("g > 0.10").select(F.lit("frontier_gap").alias("figure"), F.col("task").alias("name"), F.round("g", 6).alias("value"))
    tasks = samples(spark, d, "task_type").where("task_type is not null").select("sample_id", F.upper(F.trim("task_type")).alias("task"))
    hard = m.join(tasks, "sample_id").groupBy("task").agg(F.round(F.avg(right), 9).alias("a"))
    rank = hard.select(F.lit("difficulty_rank").alias("figure"), F.col("task").alias("name"), F.rank().over(Window.orderBy("a", "task")).cast("double").alias("value"))
    return totals.unionByName(gain).unionByName(gap).unionByName(rank)


@query(_PROBED.replace(", two", ", two", 1) + " SELECT c.config_id, count(*) AS calls, round(sum(m.cost), 6) AS cost FROM matrix m JOIN two c USING (config_id) GROUP BY ROLLUP (c.config_id)")
def probe_costs(spark: S, d: str) -> DataFrame:
    """What the two probes cost, each and together."""
    from pyspark.sql import Window

    two = table(spark, d, "model_configs").select("config_id", F.row_number().over(Window.orderBy("cost_per_1m_input", "config_id")).alias("__r")).where("__r <= 2").select("config_id")
    return matrix(spark, d).select("config_id", "cost").join(F.broadcast(two), "config_id").rollup("config_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


_DOM = """, v AS (SELECT a.sample_id, count(*) AS pairs, count(*) FILTER (WHERE NOT coalesce(b.is_correct, false)) AS violated FROM matrix a JOIN matrix b ON a.sample_id = b.sample_id AND a.tier < b.tier WHERE a.is_correct GROUP BY 1)"""


@query(
    _DOM
    + f""", buckets AS (SELECT substr(md5(sample_id), 1, 3) AS k, sum(violated) AS t, sum(pairs) AS n FROM v GROUP BY 1),
 reps AS (SELECT b, sum(t * w) * 1.0 / nullif(sum(n * w), 0) AS p FROM (SELECT b, t, n, {_WEIGHT} AS w FROM (SELECT b, t, n, CAST(('0x' || substr(md5(k || ':' || b), 1, 4)) AS INT) AS u FROM buckets, (SELECT unnest(range(200)) AS b))) GROUP BY b)
SELECT round(avg(p), 6) AS mean, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high FROM reps"""
)
def bootstrap_violation_rate(spark: S, d: str) -> DataFrame:
    """The dominance rate with whole samples resampled."""
    return statistics.bootstrap_ratio(routing.violations(matrix(spark, d)).where("pairs > 0"), "sample_id", "violated", "pairs")


@query(
    """, t AS (SELECT CAST(c.budget_tokens AS DOUBLE) AS b, CAST(ascii(c.tier) - 64 AS DOUBLE) AS k, CAST(r.reasoning_tokens AS DOUBLE) AS y, r.result_id FROM runs r JOIN model_configs c USING (config_id) WHERE r.reasoning_tokens IS NOT NULL),
 o AS (SELECT *, row_number() OVER (ORDER BY result_id) <= floor(count(*) OVER () * 0.8) AS train FROM t),
 s AS (SELECT avg(b) AS mb, avg(k) AS mk, avg(y) AS my, sum(b*b) - count(*)*avg(b)*avg(b) + 1 AS bb, sum(k*k) - count(*)*avg(k)*avg(k) + 1 AS kk, sum(b*k) - count(*)*avg(b)*avg(k) AS bk, sum(b*y) - count(*)*avg(b)*avg(y) AS yb, sum(k*y) - count(*)*avg(k)*avg(y) AS yk FROM o WHERE train),
 w AS (SELECT *, (yb*kk - yk*bk) / (bb*kk - bk*bk) AS wb, (yk*bb - yb*bk) / (bb*kk - bk*bk) AS wk FROM s)
SELECT round(1 - sum(pow(y - (my + wb*(b-mb) + wk*(k-mk)), 2)) / (sum(y*y) - count(*)*avg(y)*avg(y)), 6) AS r2 FROM o, w WHERE NOT train"""
)
def reasoning_ridge(spark: S, d: str) -> DataFrame:
    """How well budget and tier tell the reasoning tokens of later runs, with a ridge penalty."""
    return evaluation.ridge_r2(_token_rows(spark, d), ["budget_tokens", "rank"], "reasoning_tokens", ["result_id"])


def _token_rows(spark: S, d: str) -> DataFrame:
    from .base import runs

    c = table(spark, d, "model_configs").select("config_id", "budget_tokens", (F.ascii("tier") - 64).alias("rank"))
    return runs(spark, d, "config_id", "reasoning_tokens").where("reasoning_tokens is not null").join(F.broadcast(c), "config_id").withColumn("both", F.col("budget_tokens") * F.col("rank"))


@query()
def reasoning_ridge_full(spark: S, d: str) -> DataFrame:
    """The same with their product as a third feature; a test compares the closed form with a direct solution."""
    return evaluation.ridge_r2(_token_rows(spark, d), ["budget_tokens", "rank", "both"], "reasoning_tokens", ["result_id"])


_ARB = """, ends AS (SELECT result_id, first(is_correct ORDER BY ingested_at) AS a, last(is_correct ORDER BY ingested_at) AS b FROM eval_results GROUP BY 1),
 t AS (SELECT e.a, e.b, coalesce(lower(trim(r.predicted_answer)) = lower(trim(s.gt_answer)), false) AS v, CASE WHEN r.latency_ms < 3000 THEN 'high' WHEN r.latency_ms < 10000 THEN 'medium' ELSE 'low' END AS c
 FROM ends e JOIN runs r USING (result_id) JOIN samples s USING (sample_id) WHERE e.b IS NOT NULL AND coalesce(e.a, false) <> e.b)"""


@query(_ARB + " SELECT count(*) AS n, count(*) FILTER (WHERE v = coalesce(a, false)) AS with_rule, count(*) FILTER (WHERE v = b) AS with_judge, count(*) FILTER (WHERE c = 'high') AS high, count(*) FILTER (WHERE c = 'medium') AS medium, count(*) FILTER (WHERE c = 'low') AS low FROM t")
def arbitration_summary(spark: S, d: str) -> DataFrame:
    """First and last verdicts on a run that differ, with equality to the gold answer as arbiter and speed as its confidence."""
    from .base import runs

    told = evaluation.disagreements(_ends(spark, d).select("result_id", "a", "b"), "a", "b")
    r = runs(spark, d, "sample_id", "predicted_answer", "latency_ms")
    rows = told.join(r, "result_id").join(samples(spark, d, "gt_answer"), "sample_id")
    rows = rows.withColumn("v", F.coalesce(F.lower(F.trim("predicted_answer")) == F.lower(F.trim("gt_answer")), F.lit(False)))
    sure = F.when(F.col("latency_ms") < 3000, "high").when(F.col("latency_ms") < 10000, "medium").otherwise("low")
    return evaluation.arbitration(rows, "v", "a", "b", sure)


_DIFF = (
    _PROBED
    + """, k AS (SELECT c.r, upper(trim(s.task_type)) AS task, n.tier AS t, round((count(*) FILTER (WHERE m.is_correct) + 1) * 1.0 / (count(*) + 2), 6) AS p
  FROM matrix m JOIN two c USING (config_id) JOIN samples s USING (sample_id) JOIN notes n USING (sample_id) WHERE m.is_correct IS NOT NULL AND n.tier IN (1, 2, 3) AND s.task_type IS NOT NULL GROUP BY ALL),
 w AS (SELECT r, task, [coalesce(max(p) FILTER (WHERE t = 1), 0.5), coalesce(max(p) FILTER (WHERE t = 2), 0.5), coalesce(max(p) FILTER (WHERE t = 3), 0.5)] AS p FROM k GROUP BY 1, 2),
 j AS (SELECT s.sample_id, CASE WHEN n.tier IN (1, 2, 3) THEN n.tier END AS tier, n.composite AS c, b.first, b.second, w1.p AS p1, w2.p AS p2 FROM samples s LEFT JOIN notes n USING (sample_id) LEFT JOIN probed b USING (sample_id)
  LEFT JOIN w w1 ON w1.r = 1 AND w1.task = upper(trim(s.task_type)) LEFT JOIN w w2 ON w2.r = 2 AND w2.task = upper(trim(s.task_type))),
 q AS (SELECT *, CASE tier WHEN 1 THEN [0.70, 0.25, 0.05] WHEN 2 THEN [0.15, 0.65, 0.20] WHEN 3 THEN [0.10, 0.20, 0.70] ELSE [1/3, 1/3, 1/3] END AS soft, coalesce(tier, 1) AS tier_prior FROM j),
 u AS (SELECT sample_id, tier_prior, first, second, list_transform([1, 2, 3], lambda i: CAST(soft[i] AS DOUBLE) * CASE WHEN first IS NULL OR p1 IS NULL THEN 1.0 WHEN first THEN p1[i] ELSE 1 - p1[i] END * CASE WHEN second IS NULL OR p2 IS NULL THEN 1.0 WHEN second THEN p2[i] ELSE 1 - p2[i] END
   * CASE WHEN c IS NULL THEN 1.0 ELSE exp(-0.5 * pow((c - (i + 0.5)) / 0.6, 2)) END) AS x FROM q),
 z AS (SELECT *, list_transform(x, lambda v: round(v / list_sum(x), 6)) AS soft FROM u)
"""
)


@query(
    _DIFF
    + """SELECT sample_id, tier_prior, soft AS tier_soft, CASE WHEN first IS NULL AND second IS NULL THEN 'missing' WHEN first IS NOT DISTINCT FROM second THEN CASE WHEN first THEN 'both_correct' ELSE 'both_wrong' END ELSE 'disagree' END AS probe_agreement,
 CAST(first IS NOT NULL AS INT) + CAST(second IS NOT NULL AS INT) AS n_probes, list_position(soft, list_max(soft)) AS tier_final, round(soft[1] + 2 * soft[2] + 3 * soft[3], 4) AS difficulty, list_max(soft) AS confidence FROM z"""
)
def difficulty_records(spark: S, d: str) -> DataFrame:
    """The difficulty stage: prior from the grade, outcomes of two probes, and the composite."""
    from pyspark.sql import Window

    tasks = samples(spark, d, "task_type").select("sample_id", F.upper(F.trim("task_type")).alias("task"))
    grade = notes(spark, d, "tier", "composite").select("sample_id", F.when(F.col("tier").isin(1, 2, 3), F.col("tier")).alias("tier_of"), "composite")
    two = table(spark, d, "model_configs").select("config_id", F.row_number().over(Window.orderBy("cost_per_1m_input", "config_id")).alias("__r")).where("__r <= 2")
    m = matrix(spark, d).select("sample_id", "config_id", "is_correct").join(F.broadcast(two), "config_id")
    chances = evaluation.likelihoods(m, tasks.where("task is not null"), grade.where("tier_of is not null").select("sample_id", "tier_of")).join(F.broadcast(two), "config_id")
    wide = chances.groupBy("task").agg(*[F.when(F.count_if(F.col("__r") == r) > 0, F.array(*[F.coalesce(F.max(F.when((F.col("__r") == r) & (F.col("tier_of") == t), F.col("chance"))), F.lit(0.5)) for t in (1, 2, 3)])).alias(f"{n}_chances") for r, n in ((1, "first"), (2, "second"))])
    # One row per task that the probes were tried on.
    rows = tasks.join(grade, "sample_id", "left").join(probe_outcomes(spark, d), "sample_id", "left").join(wide, "task", "left")
    rows = rows.withColumn("soft", F.lit(None).cast("array<double>")).withColumnRenamed("tier_of", "tier_prior")
    return evaluation.difficulty(rows, F.col("first"), F.col("second"), F.col("composite"))


@query(", g AS (SELECT tier, sample_id, composite FROM notes WHERE tier IN (1, 2, 3) AND composite IS NOT NULL) SELECT tier, sample_id, 'give' AS side, row_number() OVER (PARTITION BY tier ORDER BY composite, sample_id) AS place FROM g QUALIFY place <= 10 UNION ALL SELECT tier, sample_id, 'take', row_number() OVER (PARTITION BY tier ORDER BY composite DESC, sample_id) AS place FROM g QUALIFY place <= 10")
def swap_candidates(spark: S, d: str) -> DataFrame:
    g = notes(spark, d, "tier", "composite").where("tier in (1, 2, 3) and composite is not null")
    return evaluation.swap_orders(g, "tier", "composite", "sample_id", 10).withColumn("place", F.col("place").cast("long"))


@query(""", s AS (SELECT is_correct AS y, inference_confidence AS p FROM runs WHERE inference_confidence IS NOT NULL AND is_correct IS NOT NULL), w AS (SELECT unnest([CAST(0.05 AS DOUBLE), 0.10, 0.15, 0.20, 0.25, 0.30]) AS width)
SELECT width, round(avg(CASE WHEN p > 1 - width OR p < width THEN 1.0 ELSE 0.0 END), 6) AS share, round(coalesce(avg(CASE WHEN (p >= 0.5) = y THEN 1.0 ELSE 0.0 END) FILTER (WHERE p > 1 - width OR p < width), 0), 6) AS accuracy FROM s, w GROUP BY 1""")
def confidence_sweep(spark: S, d: str) -> DataFrame:
    """How many inferred results are sure within a width, and how often those are right."""
    from .base import runs

    return evaluation.confidence_sweep(runs(spark, d, "inference_confidence", "is_correct").where("inference_confidence is not null"), "inference_confidence", "is_correct")


@query("SELECT name, kind, holds FROM (VALUES ('oracle', 'least', true), ('gap', 'least', true), ('cheapest_cost', 'most', true), ('missing', 'near', false)) t(name, kind, holds)", base=False)
def claim_checks(spark: S, d: str) -> DataFrame:
    """Claims that hold on any input: the oracle beats every router, the cheapest costs no more than the dearest."""
    from ..operators import results

    rows = router_metrics(spark, d)
    one = {k: F.max(F.when(F.col("router") == k, F.col("accuracy"))) for k in ("oracle", "tier")}
    cost = {k: F.max(F.when(F.col("router") == k, F.col("total_cost"))) for k in ("cheapest", "dearest")}
    wide = rows.agg((one["oracle"] - F.max("accuracy")).alias("oracle"), (one["oracle"] - one["tier"]).alias("gap"), (cost["cheapest"] - cost["dearest"]).alias("cheapest_cost"))
    figures = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("oracle", "gap", "cheapest_cost")])))
    claims = [("oracle", "least", 0.0, 1e-9), ("gap", "least", 0.0, 1e-9), ("cheapest_cost", "most", 0.0, 1e-9), ("missing", "near", 0.0, 1.0)]
    return results.check_claims(figures, claims).select("name", "kind", "holds")


_CASCADED = """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(is_correct, false) DESC, tier, cost, config_id) AS r FROM matrix) WHERE r = 1),
 l AS (SELECT b.sample_id, CASE WHEN b.is_correct THEN b.config_id END AS config_id, coalesce(s.in_anchor_set, false) AS anchor,
 (SELECT count(*) FROM matrix m WHERE m.sample_id = b.sample_id AND (coalesce(s.in_anchor_set, false) OR NOT coalesce(b.is_correct, false) OR m.tier <= b.tier)) AS calls FROM b LEFT JOIN samples s USING (sample_id))"""


@query(_CASCADED + _DOM.replace(", v AS", ", v AS", 1) + " SELECT count(*) AS samples, count(config_id) AS routable, CAST(sum(calls) AS BIGINT) AS calls, round(1 - sum(calls) * 1.0 / (SELECT count(*) FROM matrix), 6) AS calls_saved, round((SELECT sum(violated) * 1.0 / sum(pairs) FROM v), 6) AS violation_rate FROM l")
def cascade_pipeline(spark: S, d: str) -> DataFrame:
    """The stages from the matrix to checked labels, each written and read again."""
    from ..workspace import scratch_path
    from . import pipeline

    m = matrix(spark, d).select("sample_id", "config_id", "is_correct", "cost", "tier")
    splits = samples(spark, d, "in_anchor_set").select("sample_id", F.when(F.col("in_anchor_set"), "anchor").otherwise("rest").alias("split"))
    folder = scratch_path(spark, "cascade")
    pipeline.run(spark, pipeline.cascade_stages(), folder, {"matrix": m, "splits": splits})
    return spark.read.parquet(f"{folder}/validated")


@query()
def anchor_selection(spark: S, d: str) -> DataFrame:
    """150 anchors: minima per task, tier and source, then representatives of all embeddings."""
    from . import pipeline

    s = samples(spark, d, "task_type", "source_dataset", "has_table", "has_chart").join(notes(spark, d, "tier", "vds", "rds", "ses"), "sample_id")
    rows = s.where("tier in (1, 2, 3) and task_type is not null and source_dataset is not null").withColumn("task", F.upper(F.trim("task_type")))
    return pipeline.selected_anchors(rows, 150, [("task", 10), ("tier", 20)])

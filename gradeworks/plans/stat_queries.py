"""Queries over statistics, sampling and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features, stats
from ..operators import sampling, similarity, statistics
from ..sources.tables import table
from .base import matrix, notes, query, runs, samples
from .result_queries import points

S = SparkSession

_W = """round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)) END, 6) AS low,
 round(CASE WHEN n = 0 THEN 1 ELSE least(1, (k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)) END, 6) AS high"""


@query(f"SELECT config_id, {_W}, round(CASE WHEN n > 0 THEN pow(0.05, 1.0 / n) ELSE 0 END, 6) AS all_right FROM (SELECT config_id, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM matrix GROUP BY 1)")
def accuracy_intervals(spark: S, d: str) -> DataFrame:
    g = matrix(spark, d).groupBy("config_id").agg(F.count_if(F.coalesce("is_correct", F.lit(False))).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("config_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(stats.all_right_bound(F.col("n")), 6).alias("all_right"))


_WEIGHT = "CASE WHEN u < 24109 THEN 0 WHEN u < 48219 THEN 1 WHEN u < 60273 THEN 2 WHEN u < 64292 THEN 3 WHEN u < 65296 THEN 4 ELSE 5 END"
_BOOT = f""", flags AS (SELECT sample_id, CASE WHEN bool_or(coalesce(is_correct, false)) THEN 1 ELSE 0 END AS f FROM matrix GROUP BY 1),
 buckets AS (SELECT substr(md5(sample_id), 1, 3) AS k, sum(f) AS t, count(*) AS n FROM flags GROUP BY 1),
 reps AS (SELECT b, sum(t * w) * 1.0 / sum(n * w) AS p FROM (SELECT b, t, n, {_WEIGHT} AS w FROM (SELECT b, t, n, CAST(('0x' || substr(md5(k || ':' || b), 1, 4)) AS INT) AS u FROM buckets, (SELECT unnest(range(200)) AS b))) GROUP BY b)
SELECT round(avg(p), 6) AS mean, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high FROM reps"""


@query(_BOOT)
def bootstrap_routable_share(spark: S, d: str) -> DataFrame:
    flags = matrix(spark, d).groupBy("sample_id").agg(F.bool_or(F.coalesce("is_correct", F.lit(False))).cast("int").alias("f"))
    return statistics.bootstrap_share(flags, "sample_id", "f", replicates=200)


@query("""SELECT round(max(abs(fa - fb)), 6) AS ks FROM (SELECT x, sum(a) OVER (ORDER BY x) * 1.0 / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) * 1.0 / sum(b) OVER () AS fb FROM (
 SELECT image_bytes_size AS x, count(*) FILTER (WHERE in_anchor_set) AS a, count(*) FILTER (WHERE NOT in_anchor_set) AS b FROM samples WHERE image_bytes_size IS NOT NULL GROUP BY 1))""")
def ks_anchor_sizes(spark: S, d: str) -> DataFrame:
    return statistics.ks_statistic(samples(spark, d, "image_bytes_size", "in_anchor_set"), "image_bytes_size", F.col("in_anchor_set"))


@query("""SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
 FROM (SELECT input_tokens AS a, total_cost_usd AS b FROM runs WHERE input_tokens IS NOT NULL AND total_cost_usd IS NOT NULL AND NOT isnan(total_cost_usd) AND total_cost_usd >= 0))""")
def spearman_tokens_cost(spark: S, d: str) -> DataFrame:
    r = runs(spark, d, "input_tokens", "total_cost_usd").where("input_tokens is not null and total_cost_usd is not null and not isnan(total_cost_usd) and total_cost_usd >= 0")
    return statistics.spearman(r, "input_tokens", "total_cost_usd")


@query("""SELECT round((sum(r) FILTER (WHERE y) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM (SELECT y, r, count(*) FILTER (WHERE y) OVER () AS n1, count(*) FILTER (WHERE NOT y) OVER () AS n0 FROM (
 SELECT is_correct AS y, rank() OVER (ORDER BY inference_confidence) + (count(*) OVER (PARTITION BY inference_confidence) - 1) / 2.0 AS r FROM runs WHERE inference_confidence IS NOT NULL AND is_correct IS NOT NULL)) GROUP BY n1, n0""")
def auc_of_confidence(spark: S, d: str) -> DataFrame:
    return statistics.auc(runs(spark, d, "inference_confidence", "is_correct").where("inference_confidence is not null and is_correct is not null"), "inference_confidence", F.col("is_correct"))


@query(", t AS (SELECT output_tokens AS x, latency_ms AS y FROM runs WHERE result_type = 'observed' AND output_tokens IS NOT NULL AND latency_ms >= 0) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM t")
def latency_regression(spark: S, d: str) -> DataFrame:
    t = runs(spark, d, "result_type", "output_tokens", "latency_ms").where("result_type = 'observed' and output_tokens is not null and latency_ms >= 0")
    return t.agg(F.round(F.regr_slope("latency_ms", "output_tokens"), 6).alias("slope"), F.round(F.regr_intercept("latency_ms", "output_tokens"), 4).alias("intercept"), F.round(F.regr_r2("latency_ms", "output_tokens"), 6).alias("r2"))


@query(""", k AS (SELECT sample_id, model_name, count(*) FILTER (WHERE is_correct) AS k, count(*) AS n FROM matrix WHERE is_correct IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT *, pow(CAST(0.9 AS DOUBLE), k) * pow(CAST(1 AS DOUBLE) - 0.9, n - k) AS a, pow(CAST(0.7 AS DOUBLE), k) * pow(CAST(1 AS DOUBLE) - 0.7, n - k) AS b, pow(CAST(0.3 AS DOUBLE), k) * pow(CAST(1 AS DOUBLE) - 0.3, n - k) AS c FROM k)
SELECT sample_id, model_name, round((a + 2*b + 3*c) / (a + b + c), 6) AS difficulty FROM p""")
def bayes_difficulty(spark: S, d: str) -> DataFrame:
    """Expected tier of every sample after the outcomes of each model, as one product per tier."""
    right = matrix(spark, d).where("is_correct is not null").groupBy("sample_id", "model_name").agg(F.count_if("is_correct").alias("k"), F.count(F.lit(1)).alias("n"))
    chance = F.array(*[F.pow(F.lit(p), F.col("k")) * F.pow(F.lit(1 - p), F.col("n") - F.col("k")) for p in (0.9, 0.7, 0.3)])
    soft = stats.bayes(F.array(*[F.lit(1.0 / 3)] * 3), [chance])
    return right.select("sample_id", "model_name", F.round(stats.expected_rank(soft), 6).alias("difficulty"))


@query("""SELECT label, round(sqrt(sum((x - c) * (x - c)) / count(DISTINCT vec_id)), 5) AS spread FROM (SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x, avg(CAST(x AS DOUBLE)) OVER (PARTITION BY label, i) AS c FROM (
 SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY 1""", base=False)
def distance_to_centroid(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return c.groupBy("label").agg(F.round(F.sqrt(F.sum("v")), 5).alias("spread"))


# Sampling

_RANDOM = "md5(sample_id || ':42')"


@query(f"SELECT sample_id FROM samples WHERE source_dataset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_dataset ORDER BY {_RANDOM}, sample_id) <= 20")
def quota_per_source(spark: S, d: str) -> DataFrame:
    s = samples(spark, d, "source_dataset").where("source_dataset is not null").select("sample_id", "source_dataset")
    return sampling.per_group(s, "source_dataset", 20, "sample_id").select("sample_id")


@query(f""", g AS (SELECT s.sample_id, n.tier FROM samples s JOIN notes n USING (sample_id) WHERE n.tier IN (1,2,3)),
 c AS (SELECT tier, count(*) AS n, sum(count(*)) OVER () AS total FROM g GROUP BY 1),
 q AS (SELECT tier, n, total, CAST(round_even(300 * n / total, 0) AS BIGINT) AS raw FROM c),
 w AS (SELECT *, coalesce(sum(raw) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, tier = max(tier) OVER () AS l FROM q)
SELECT g.sample_id, g.tier FROM g JOIN w USING (tier) QUALIFY row_number() OVER (PARTITION BY g.tier ORDER BY {_RANDOM}, g.sample_id) <= CASE WHEN max(w.total) OVER () <= 300 THEN w.n WHEN w.l THEN 300 - w.b ELSE w.raw END""")
def proportional_tiers(spark: S, d: str) -> DataFrame:
    g = samples(spark, d, "ingested_at").select("sample_id").join(notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", "tier"), "sample_id")
    return sampling.proportional(g, "tier", 300, [sampling.hash_order("sample_id"), "sample_id"])


@query(f"SELECT sample_id FROM samples WHERE source_dataset IS NOT NULL AND task_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_dataset, task_type ORDER BY {_RANDOM}, sample_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source_dataset, task_type) * 0.1))")
def stratified_tenth(spark: S, d: str) -> DataFrame:
    s = samples(spark, d, "source_dataset", "task_type").where("source_dataset is not null and task_type is not null").select("sample_id", "source_dataset", "task_type")
    return sampling.stratified(s, ["source_dataset", "task_type"], 0.1, "sample_id").select("sample_id")


@query(f""", g AS (SELECT sample_id, tier FROM notes WHERE tier IN (1,2,3)), r AS (SELECT *, {_RANDOM} AS h, row_number() OVER (PARTITION BY tier ORDER BY {_RANDOM}, sample_id) AS k FROM g)
SELECT sample_id, tier FROM r ORDER BY k <= CASE tier WHEN 1 THEN 60 WHEN 2 THEN 90 ELSE 50 END DESC, h, sample_id LIMIT 200""")
def validation_sample(spark: S, d: str) -> DataFrame:
    g = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", "tier")
    return sampling.weighted_tiers(g, "tier", 200, {1: 0.3, 2: 0.45, 3: 0.25}, "sample_id")


@query("""SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id), 4) AS spent FROM events QUALIFY sum(value) OVER (ORDER BY ts, event_id) < 5000""", base=False)
def spend_guard(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "value")
    return sampling.keep_within(e, 5000.0, "value", ["ts", "event_id"]).select("event_id", F.round("spent", 4).alias("spent"))


@query()
def diverse_selection(spark: S, d: str) -> DataFrame:
    s = samples(spark, d, "task_type", "source_dataset", "doc_type", "has_table", "has_chart", "has_figure", "num_pages").where("task_type is not null").withColumn("task", F.upper(F.trim("task_type"))).join(notes(spark, d, "composite", "tier").select("sample_id", "composite", "tier"), "sample_id")
    return sampling.diverse(s, "task", ["source_dataset", "doc_type", "has_table", "has_chart", "has_figure", "num_pages", "tier"], "composite", "sample_id", quota=25)


@query()
def facility_location(spark: S, d: str) -> DataFrame:
    graded = notes(spark, d, "tier", "vds", "rds", "ses").where("tier in (1,2,3) and vds is not null and rds is not null and ses is not null")
    vector = F.concat(features.one_hot(F.col("tier").cast("string"), ("1", "2", "3")), F.array(F.col("vds") / 4, F.col("rds") / 4, F.col("ses") / 4))
    return sampling.facility_location(graded.select("sample_id", vector.alias("v")), "v", "sample_id", 30, 1.0)


@query()
def representative_vectors(spark: S, d: str) -> DataFrame:
    """150 vectors that cover all embeddings best, under a kernel as wide as their median distance."""
    return sampling.facility_location(table(spark, d, "embeddings"), "embedding", "vec_id", 150, 1.41)


# Similarity


@query("""SELECT query_id, neighbour_id, rank, round(cosine, 5) AS cosine FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
 round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5""", base=False)
def nearest_vectors(spark: S, d: str) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 50, against all vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return similarity.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("query_id", "neighbour_id", F.col("rank").cast("long").alias("rank"), F.round("cosine", 5).alias("cosine"))


@query("""SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS r FROM (
 SELECT a.vec_id AS query_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS k
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE k <= 5 GROUP BY 1, 2) WHERE r = 1""", base=False)
def neighbour_vote(spark: S, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("neighbour_id"), "label")
    votes = nearest_vectors(spark, d).join(labels, "neighbour_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))


def _fingerprints(spark: S, d: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("query"), r"\s+"))
    return samples(spark, d, "query").where("query is not null").select("sample_id", similarity.simhash(words).alias("h"))


_PRINTS = r""", words AS (SELECT sample_id, unnest(list_distinct(regexp_split_to_array(lower(query), '\s+'))) AS w FROM samples WHERE query IS NOT NULL),
 halves AS (SELECT sample_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) AS hi, CAST(('0x' || substr(md5(w), 9, 8)) AS BIGINT) AS lo FROM words),
 bits AS (SELECT sample_id, i, sum(CASE WHEN ((CASE WHEN i >= 32 THEN hi ELSE lo END) >> (i % 32)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM halves, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2),
 prints AS (SELECT sample_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h FROM (SELECT sample_id, sum(CASE WHEN s > 0 THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END) AS u FROM bits GROUP BY 1)),
 links AS (SELECT a.h AS a, b.h AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM (SELECT DISTINCT h FROM prints) a JOIN (SELECT DISTINCT h FROM prints) b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 8)"""


@query(_PRINTS + " SELECT a, b, distance FROM links")
def near_fingerprints(spark: S, d: str) -> DataFrame:
    """Links between the fingerprints of different queries that differ in up to 8 of 64 bits."""
    return similarity.near_hashes(_fingerprints(spark, d), "sample_id", "h", 8)


@query(
    (_PRINTS + """, ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach(v, r) AS (SELECT DISTINCT a, a FROM ways UNION SELECT x.v, y.b FROM reach x JOIN ways y ON x.r = y.a),
 classes AS (SELECT v, min(r) AS c FROM reach GROUP BY 1), counts AS (SELECT a, count(*) AS n FROM ways GROUP BY 1)
SELECT p.sample_id, p.h AS fingerprint, coalesce(c.c, p.h) AS class, coalesce(n.n, 0) AS links FROM prints p LEFT JOIN classes c ON c.v = p.h LEFT JOIN counts n ON n.a = p.h"""),
    recursive=True,
)
def near_fingerprint_members(spark: S, d: str) -> DataFrame:
    """Per sample its fingerprint, its class over those links and how many links its fingerprint has."""
    return similarity.near_members(_fingerprints(spark, d), "sample_id", "h", 8)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL ORDER BY md5(vec_id || ':42'), vec_id LIMIT 2000)
SELECT round(sqrt(median(list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(z[1] - z[2], 2))))), 6) AS sigma FROM v a JOIN v b ON a.vec_id < b.vec_id""", base=False)
def kernel_width(spark: S, d: str) -> DataFrame:
    return similarity.kernel_width(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("SELECT config_id, cost_rank FROM (SELECT config_id, dense_rank() OVER (ORDER BY cost_per_1m_input, budget_tokens) AS cost_rank FROM model_configs)", base=False)
def config_order(spark: S, d: str) -> DataFrame:
    return table(spark, d, "model_configs").select("config_id", F.dense_rank().over(Window.orderBy("cost_per_1m_input", "budget_tokens")).cast("long").alias("cost_rank"))


@query(", points AS (SELECT config_id, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(cost), 8) AS cost FROM matrix GROUP BY 1) SELECT config_id, rank() OVER (ORDER BY accuracy DESC) AS place, round(cume_dist() OVER (ORDER BY cost), 6) AS cost_share FROM points")
def config_ranking(spark: S, d: str) -> DataFrame:
    p = points(spark, d)
    return p.select("config_id", F.rank().over(Window.orderBy(F.desc("accuracy"))).cast("long").alias("place"), F.round(F.cume_dist().over(Window.orderBy("cost")), 6).alias("cost_share"))

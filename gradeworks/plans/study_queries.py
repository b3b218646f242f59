"""Queries over studies of stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import results, studies
from ..sources.tables import table
from .base import matrix, notes, query, runs, samples

S = SparkSession

_ENDS = ", ends AS (SELECT result_id, config_id, result_type, first(is_correct ORDER BY ingested_at) AS a, last(is_correct ORDER BY ingested_at) AS b FROM eval_results GROUP BY 1, 2, 3)"


def _ends(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "eval_results").select("result_id", "config_id", "result_type", "ingested_at", "is_correct")
    return e.groupBy("result_id", "config_id", "result_type").agg(F.min(F.struct("ingested_at", "is_correct"))["is_correct"].alias("a"), F.max(F.struct("ingested_at", "is_correct"))["is_correct"].alias("b"))


@query(_ENDS + "SELECT result_id, a AS before, b AS after FROM ends WHERE a IS DISTINCT FROM b AND b IS NOT NULL")
def corrected_runs(spark: S, d: str) -> DataFrame:
    return _ends(spark, d).where(~F.col("a").eqNullSafe(F.col("b")) & F.col("b").isNotNull()).select("result_id", F.col("a").alias("before"), F.col("b").alias("after"))


@query(_ENDS + "SELECT config_id, result_type, count(*) AS n, round(avg(CASE WHEN a IS DISTINCT FROM b THEN 1.0 ELSE 0.0 END), 6) AS flip_rate FROM ends GROUP BY GROUPING SETS ((), (config_id), (result_type))")
def flip_report(spark: S, d: str) -> DataFrame:
    flipped = (~F.col("a").eqNullSafe(F.col("b"))).cast("double")
    return _ends(spark, d).groupingSets([[], ["config_id"], ["result_type"]], "config_id", "result_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(flipped), 6).alias("flip_rate"))


@query("SELECT 'T' || a || '->T' || b AS shift, count(*) AS n FROM (SELECT sample_id, first(tier ORDER BY annotated_at, tier) AS a, last(tier ORDER BY annotated_at, tier) AS b FROM complexity_annotations WHERE tier IN (1,2,3) GROUP BY 1) GROUP BY 1", base=False)
def tier_shifts(spark: S, d: str) -> DataFrame:
    g = table(spark, d, "complexity_annotations").where("tier in (1,2,3)").groupBy("sample_id").agg(F.min(F.struct("annotated_at", "tier"))["tier"].alias("a"), F.max(F.struct("annotated_at", "tier"))["tier"].alias("b"))
    return g.groupBy(F.format_string("T%d->T%d", "a", "b").alias("shift")).agg(F.count(F.lit(1)).alias("n"))


_LAST = """ last AS (SELECT * FROM judge_scores WHERE judge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id, judge_id ORDER BY rated_at DESC, ingested_at DESC) = 1),
 long AS (SELECT sample_id, judge_id, unnest(['vds', 'rds', 'ses']) AS axis, unnest([vds, rds, ses]) AS score FROM last)"""


@query(f"WITH {_LAST} SELECT a.axis, count(*) AS compared, count(*) FILTER (WHERE a.score = b.score) AS equal FROM long a JOIN long b ON a.sample_id = b.sample_id AND a.axis = b.axis AND a.judge_id < b.judge_id WHERE a.score BETWEEN 1 AND 4 AND b.score BETWEEN 1 AND 4 GROUP BY 1", base=False)
def axis_agreement(spark: S, d: str) -> DataFrame:
    """Over all pairs of judges of a sample: how many there are and how many agree, by counts of scores instead of pairs."""
    last = results.last_by(table(spark, d, "judge_scores").where("judge_id is not null and sample_id is not null").select("sample_id", "judge_id", "rated_at", "ingested_at", "vds", "rds", "ses"), ["sample_id", "judge_id"], ["rated_at", "ingested_at"])
    long = last.select("sample_id", F.explode(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(x).alias("score")) for x in ("vds", "rds", "ses")])).alias("p")).select("sample_id", "p.*").where("score between 1 and 4")
    same = long.groupBy("axis", "sample_id", "score").agg(F.count(F.lit(1)).alias("n"))
    per = same.groupBy("axis", "sample_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("e"))
    found = per.where("n > 1").groupBy("axis").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("c"), F.sum("e").alias("e"))
    return found.select("axis", (F.col("c") / 2).cast("long").alias("compared"), (F.col("e") / 2).cast("long").alias("equal"))


_PERM = " UNION ALL ".join(f"SELECT '{a}-{b}-{c}' AS axes, round(corr({a}*CAST(0.3 AS DOUBLE) + {b}*CAST(0.45 AS DOUBLE) + {c}*CAST(0.25 AS DOUBLE), tier), 6) AS correlation FROM g" for a, b, c in (("vds", "rds", "ses"), ("vds", "ses", "rds"), ("rds", "vds", "ses"), ("rds", "ses", "vds"), ("ses", "vds", "rds"), ("ses", "rds", "vds")))


@query(f", g AS (SELECT vds, rds, ses, tier FROM notes WHERE tier IN (1,2,3) AND vds IS NOT NULL AND rds IS NOT NULL AND ses IS NOT NULL) {_PERM}")
def axis_permutations(spark: S, d: str) -> DataFrame:
    g = notes(spark, d, "vds", "rds", "ses", "tier").where("tier in (1,2,3) and vds is not null and rds is not null and ses is not null")
    return studies.permuted_correlations(g, ("vds", "rds", "ses"), (0.3, 0.45, 0.25), "tier")


_PROBES = """, probes AS (SELECT m.sample_id, bool_or(is_correct) FILTER (WHERE config_id = 'a1_flint_B1') AS p, bool_or(is_correct) FILTER (WHERE config_id = 'c1_onyx_B2') AS q, max(n.composite) AS c
 FROM matrix m JOIN notes n USING (sample_id) GROUP BY 1)"""
_TIER = "CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1 WHEN {k} = 0 THEN CASE WHEN c >= 2.8 THEN 3 ELSE 2 END WHEN c < 2.5 THEN 2 ELSE 3 END"
_BOTH = _TIER.format(n="((p IS NOT NULL)::INT + (q IS NOT NULL)::INT)", k="(coalesce(p::INT, 0) + coalesce(q::INT, 0))")
_ONE = _TIER.format(n="((p IS NOT NULL)::INT)", k="(coalesce(p::INT, 0))")


def _probes(spark: S, d: str) -> DataFrame:
    m = matrix(spark, d).join(notes(spark, d, "composite").select("sample_id", "composite"), "sample_id")
    return m.groupBy("sample_id").agg(*[F.bool_or(F.when(F.col("config_id") == c, F.col("is_correct"))).alias(n) for n, c in (("p", "a1_flint_B1"), ("q", "c1_onyx_B2"))], F.max("composite").alias("c"))


@query(_PROBES + f"SELECT sample_id, {_BOTH} AS tier FROM probes")
def probe_tiers(spark: S, d: str) -> DataFrame:
    return _probes(spark, d).select("sample_id", studies.probe_tier([F.col("p"), F.col("q")], F.col("c")).alias("tier"))


@query(_PROBES + f"SELECT count(*) AS n, round(avg(CASE WHEN {_BOTH} = {_ONE} THEN 1.0 ELSE 0.0 END), 6) AS unchanged FROM probes WHERE p IS NOT NULL AND q IS NOT NULL")
def ablation_stability(spark: S, d: str) -> DataFrame:
    both, one = studies.probe_tier([F.col("p"), F.col("q")], F.col("c")), studies.probe_tier([F.col("p")], F.col("c"))
    return _probes(spark, d).where("p is not null and q is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((both == one).cast("double")), 6).alias("unchanged"))


_SHOWN = "CASE WHEN c < 2.5 THEN 2.4 WHEN c < 2.8 THEN 2.6 ELSE 2.9 END"
_FLIPS = " + ".join(
    f"(CASE WHEN t00 IS NOT DISTINCT FROM t{a}{b} THEN {'(CASE WHEN p IS NULL THEN ' + ('0.0' if a else '1.0') + ' ELSE ' + ('0.1' if a else '0.9') + ' END)'} * {'(CASE WHEN q IS NULL THEN ' + ('0.0' if b else '1.0') + ' ELSE ' + ('0.1' if b else '0.9') + ' END)'} ELSE 0.0 END)"
    for a in (0, 1)
    for b in (0, 1)
)


@query(
    _PROBES
    + ", flipped AS (SELECT p, q, "
    + ", ".join(f"(SELECT {_BOTH} FROM (SELECT {'NOT o.p' if a else 'o.p'} AS p, {'NOT o.q' if b else 'o.q'} AS q, o.c AS c)) AS t{a}{b}" for a in (0, 1) for b in (0, 1))
    + f""" FROM probes o WHERE c IS NOT NULL), chances AS (SELECT CAST({_FLIPS} AS DOUBLE) AS s FROM flipped WHERE t00 IS NOT NULL)
SELECT round(sum(s) / count(*), 6) AS mean, round(sqrt(sum(s * (1 - s))) / count(*), 6) AS deviation FROM chances"""
)
def perturbation_stability(spark: S, d: str) -> DataFrame:
    return studies.perturbed(_probes(spark, d), ["p", "q"], "c")


@query()
def perturbation_trials(spark: S, d: str) -> DataFrame:
    """Drawn by a generator that SQL lacks; tests hold it against the exact moments."""
    return studies.perturbation_trials(_probes(spark, d), ["p", "q"], "c")


_SEEDED = """, g AS (SELECT n.sample_id, n.tier, upper(trim(s.task_type)) AS task FROM notes n JOIN samples s USING (sample_id) WHERE n.tier IN (1,2,3) AND s.task_type IS NOT NULL),
 c AS (SELECT tier, task, count(*) AS n, 60.0 * count(*) / sum(count(*)) OVER () AS e FROM g GROUP BY 1, 2),
 o AS (SELECT *, least(n, greatest(1, floor(e))) AS own FROM c), l AS (SELECT *, 60 - sum(own) OVER () AS l, own < n AS room FROM o),
 q AS (SELECT *, own + CASE WHEN room AND row_number() OVER (ORDER BY room DESC, floor(e) - e, tier, task) <= l THEN 1 ELSE 0 END AS quota FROM l)
SELECT sample_id, tier, task FROM (SELECT g.*, q.quota, row_number() OVER (PARTITION BY g.tier, g.task ORDER BY md5(g.sample_id || ':42'), g.sample_id) AS r FROM g JOIN q USING (tier, task)) WHERE r <= quota"""


@query(_SEEDED)
def seed_sample(spark: S, d: str) -> DataFrame:
    g = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", "tier").join(samples(spark, d, "task_type").where("task_type is not null").select("sample_id", F.upper(F.trim("task_type")).alias("task")), "sample_id")
    return studies.seeds(g, ["tier", "task"], 60, "sample_id")


_MINIMA = """, g AS (SELECT n.sample_id, n.tier, upper(trim(s.task_type)) AS task, s.source_dataset, md5(n.sample_id || ':42') AS h FROM notes n JOIN samples s USING (sample_id) WHERE n.tier IN (1,2,3) AND s.task_type IS NOT NULL AND s.source_dataset IS NOT NULL),
 a AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY task ORDER BY h, sample_id) <= 10),
 b AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY h, sample_id) AS r FROM g WHERE sample_id NOT IN (SELECT sample_id FROM a)) f WHERE r <= 25 - (SELECT count(*) FROM a WHERE a.tier = f.tier)),
 ab AS (SELECT sample_id, tier, task, source_dataset FROM a UNION ALL SELECT sample_id, tier, task, source_dataset FROM b),
 c AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY h, sample_id) AS r FROM g WHERE sample_id NOT IN (SELECT sample_id FROM ab)) f WHERE r <= 5 - (SELECT count(*) FROM ab WHERE ab.source_dataset = f.source_dataset))
SELECT * FROM ab UNION ALL SELECT sample_id, tier, task, source_dataset FROM c"""


@query(_MINIMA)
def constrained_sample(spark: S, d: str) -> DataFrame:
    g = notes(spark, d, "tier").where("tier in (1,2,3)").select("sample_id", "tier").join(samples(spark, d, "task_type", "source_dataset").where("task_type is not null and source_dataset is not null").select("sample_id", F.upper(F.trim("task_type")).alias("task"), "source_dataset"), "sample_id")
    return studies.constrained(g, [("task", 10), ("tier", 25), ("source_dataset", 5)], "sample_id")


@query(""", g AS (SELECT n.sample_id, s.source_dataset AS src FROM notes n JOIN samples s USING (sample_id) WHERE n.composite IS NOT NULL AND s.source_dataset IS NOT NULL),
 c AS (SELECT src, count(*) AS n, CAST(200 AS DOUBLE) * count(*) / sum(count(*)) OVER () AS e FROM g GROUP BY 1),
 o AS (SELECT *, least(n, floor(e)) AS own FROM c), l AS (SELECT *, 200 - sum(own) OVER () AS l, own < n AS room FROM o),
 q AS (SELECT src, n, CAST(own + CASE WHEN room AND row_number() OVER (ORDER BY room DESC, floor(e) - e, src) <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM l),
 w AS (SELECT *, greatest(quota, least(15, n)) AS want, greatest(0, quota - 15) AS above FROM q),
 x AS (SELECT *, CASE WHEN sum(above) OVER () > 0 THEN least(sum(want - quota) OVER (), sum(above) OVER ()) * CAST(above AS DOUBLE) / sum(above) OVER () ELSE 0.0 END AS e FROM w),
 y AS (SELECT *, round(sum(e) OVER ()) - sum(floor(e)) OVER () AS l FROM x),
 z AS (SELECT src, want - floor(e) - CASE WHEN row_number() OVER (ORDER BY floor(e) - e, src) <= l THEN 1 ELSE 0 END AS quota FROM y)
SELECT sample_id, src AS source_dataset FROM (SELECT g.*, z.quota, row_number() OVER (PARTITION BY src ORDER BY md5(g.sample_id || ':42'), g.sample_id) AS r FROM g JOIN z USING (src)) WHERE r <= quota""")
def floored_sample(spark: S, d: str) -> DataFrame:
    """Rows of each source by largest remainder, with a floor of 15 rows a source inside one total."""
    g = notes(spark, d, "composite").where("composite is not null").select("sample_id").join(samples(spark, d, "source_dataset").where("source_dataset is not null").select("sample_id", "source_dataset"), "sample_id")
    return studies.floored(g, "source_dataset", 200, 15, "sample_id").select("sample_id", "source_dataset")


@query("""SELECT name, arg_min(c.source_dataset, (CASE WHEN c.source_dataset = name THEN 0 WHEN lower(c.source_dataset) = lower(name) THEN 1 ELSE 2 END) || c.source_dataset) AS catalogue
FROM (SELECT DISTINCT source_dataset AS name FROM bench_samples WHERE source_dataset IS NOT NULL) n LEFT JOIN image_collections c
ON c.source_dataset = name OR lower(c.source_dataset) = lower(name) OR contains(lower(name), lower(c.source_dataset)) OR contains(lower(c.source_dataset), lower(name)) GROUP BY 1""", base=False)
def catalogue_names(spark: S, d: str) -> DataFrame:
    left = table(spark, d, "bench_samples").select(F.col("source_dataset").alias("name"))
    return studies.matched_names(left, table(spark, d, "image_collections").select(F.col("source_dataset").alias("catalogue")), "name", "catalogue")


@query("SELECT n, count(*) AS samples FROM (SELECT sample_id, count(DISTINCT config_id) AS n FROM runs GROUP BY 1) GROUP BY 1")
def coverage_histogram(spark: S, d: str) -> DataFrame:
    per = runs(spark, d, "sample_id", "config_id").groupBy("sample_id").agg(F.count_distinct("config_id").alias("n"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("samples"))

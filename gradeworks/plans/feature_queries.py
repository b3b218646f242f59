"""Queries over feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, vectors
from ..sources.tables import table
from .base import matrix, notes, query, samples

S = SparkSession

_SRC = r"regexp_replace(lower(source_dataset), '[\s\-_]+', '', 'g')"
_TASK = "upper(trim(task_type))"


def _hot(value: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN {value} = '{x}' THEN 1.0 ELSE 0.0 END" for x in names)


def _on(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def _list(*parts: str) -> str:
    return f"CAST([{', '.join(parts)}] AS DOUBLE[])"


_J = ", j AS (SELECT s.*, n.tier, n.vds, n.rds, n.ses, n.composite FROM samples s LEFT JOIN notes n USING (sample_id))"


def _joined(spark: S, d: str, *keep: str) -> DataFrame:
    return samples(spark, d, *keep).join(notes(spark, d, "tier", "vds", "rds", "ses", "composite"), "sample_id", "left")


def _scores() -> list[Column]:
    return [F.col(c) for c in ("vds", "rds", "ses")]


def _task() -> Column:
    return F.upper(F.trim("task_type"))


@query(
    _J
    + "SELECT sample_id, "
    + _list(_hot(_TASK, features.TASKS), _hot("CAST(coalesce(tier, 2) AS VARCHAR)", ("1", "2", "3")), _hot(_SRC, tuple(x.lower().replace("-", "") for x in vectors.SOURCES)), "coalesce(vds, 2) / 4.0", "coalesce(rds, 2) / 4.0", "coalesce(ses, 1) / 4.0", _on("has_table"), _on("has_chart"))
    + " AS embedding FROM j"
)
def sample_embeddings(spark: S, d: str) -> DataFrame:
    j = _joined(spark, d, "task_type", "source_dataset", "has_table", "has_chart")
    return j.select("sample_id", vectors.sample_embedding(_task(), F.col("tier"), F.col("source_dataset"), _scores(), F.col("has_table"), F.col("has_chart")).alias("embedding"))


@query(_J + "SELECT sample_id, " + _list("coalesce(vds, 2) / 4.0", "coalesce(rds, 2) / 4.0", "coalesce(ses, 2) / 4.0", _on("has_table") + " * 0.5", _on("has_chart") + " * 0.5", "coalesce(length(query), 0) / 100.0") + " AS features FROM j")
def quality_features(spark: S, d: str) -> DataFrame:
    j = _joined(spark, d, "query", "has_table", "has_chart")
    return j.select("sample_id", vectors.quality_features(_scores(), F.col("has_table"), F.col("has_chart"), F.col("query")).alias("features"))


_GOLD = r"lower(regexp_replace(coalesce(gt_answer, ''), '^\s+|\s+$', '', 'g'))"
_SHORT = rf"CASE WHEN {_GOLD} IN ('yes', 'no', 'true', 'false') THEN 'boolean' WHEN regexp_matches(regexp_replace({_GOLD}, '[,%]', '', 'g'), '^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$') THEN 'numeric' END"
_TYPE = rf"""CASE WHEN correctness_metric IN ('exact_match', 'denotation') THEN coalesce({_SHORT}, 'extractive')
 WHEN correctness_metric IN ('anls', 'vqa_accuracy', 'slidevqa_em', 'rouge_cider') THEN coalesce({_SHORT}, CASE WHEN len(list_filter(regexp_split_to_array({_GOLD}, '\s+'), lambda w: w <> '')) > 5 THEN 'abstractive' ELSE 'extractive' END) ELSE 'extractive' END"""


@query(f"SELECT sample_id, {_TYPE} AS answer_type FROM samples")
def answer_types(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "correctness_metric", "gt_answer").select("sample_id", vectors.answer_type(F.col("correctness_metric"), F.col("gt_answer")).alias("answer_type"))


#: The two cheapest configurations of model_configs by rate and name stand for the two probes.
_PROBED = """, two AS (SELECT config_id, row_number() OVER (ORDER BY cost_per_1m_input, config_id) AS r FROM model_configs QUALIFY r <= 2),
 probed AS (SELECT m.sample_id, bool_or(is_correct) FILTER (WHERE r = 1) AS first, bool_or(is_correct) FILTER (WHERE r = 2) AS second FROM matrix m JOIN two USING (config_id) GROUP BY 1)"""
_AGREE = "CASE WHEN first IS NULL AND second IS NULL THEN 'missing' WHEN first IS NOT DISTINCT FROM second THEN CASE WHEN first THEN 'both_correct' ELSE 'both_wrong' END ELSE 'disagree' END"


def probe_outcomes(spark: S, d: str) -> DataFrame:
    """``sample_id, first, second``: outcomes of the two cheapest configurations, which stand for the probes."""
    from pyspark.sql import Window

    two = table(spark, d, "model_configs").select("config_id", F.row_number().over(Window.orderBy("cost_per_1m_input", "config_id")).alias("__r")).where("__r <= 2")
    m = matrix(spark, d).select("sample_id", "config_id", "is_correct").join(F.broadcast(two), "config_id")
    return m.groupBy("sample_id").agg(*[F.bool_or(F.when(F.col("__r") == i, F.col("is_correct"))).alias(n) for i, n in ((1, "first"), (2, "second"))])


_COMPLEX = "CAST(0.30 AS DOUBLE) * coalesce(vds, 2) + CAST(0.45 AS DOUBLE) * coalesce(rds, 2) + CAST(0.25 AS DOUBLE) * coalesce(ses, 2)"
_FLAGS = ("has_table", "has_chart", "has_figure", "has_handwriting")
_ELEMENTS = " + ".join(f"CAST(coalesce({f}, false) AS INT)" for f in _FLAGS)


def elements() -> Column:
    """How many kinds of visual elements a sample is flagged with."""
    return sum((features.flag(f).cast("int") for f in _FLAGS[1:]), features.flag(_FLAGS[0]).cast("int"))


@query(
    _J
    + _PROBED
    + f""" SELECT sample_id, [coalesce({_TASK}, ''), coalesce({_SRC}, ''), coalesce(doc_type, ''), {', '.join(f"CASE WHEN {f} THEN '1' ELSE '0' END" for f in _FLAGS)}, CAST(least({_ELEMENTS}, 3) AS VARCHAR), {_TYPE},
 CASE WHEN round({_COMPLEX}, 9) < 2.0 THEN 'low' WHEN round({_COMPLEX}, 9) < 3.0 THEN 'medium' ELSE 'high' END, {_AGREE}] AS categories FROM j LEFT JOIN probed USING (sample_id)"""
)
def diversity_tuples(spark: S, d: str) -> DataFrame:
    """The eleven categories that samples are told apart by."""
    from ..functions.text import canonical_name

    j = _joined(spark, d, "task_type", "source_dataset", "doc_type", *_FLAGS, "correctness_metric", "gt_answer").join(probe_outcomes(spark, d), "sample_id", "left")
    kind = vectors.answer_type(F.col("correctness_metric"), F.col("gt_answer"))
    made = vectors.diversity_tuple(_task(), canonical_name(F.col("source_dataset")), F.col("doc_type"), [F.col(f) for f in _FLAGS], elements(), kind, vectors.complexity_bin(_scores()), vectors.probe_agreement(F.col("first"), F.col("second")))
    return j.select("sample_id", made.alias("categories"))


def router_rows(spark: S, d: str) -> DataFrame:
    """``sample_id, x``: the 48 router features of every sample, and its tier and composite."""
    keep = ("task_type", "doc_type", "num_pages", "query", *_FLAGS, "image_bytes_size")
    j = _joined(spark, d, *keep).join(probe_outcomes(spark, d), "sample_id", "left").withColumn("__elements", elements())
    row = {c: F.col(c) for c in ("vds", "rds", "ses", "composite", "doc_type", "num_pages", "query", *_FLAGS, "tier", "first", "second")}
    made = vectors.router_features(row | {"task": _task(), "elements": F.col("__elements"), "image_bytes": F.col("image_bytes_size")})
    return j.select("sample_id", made.alias("x"), "tier", "composite", _task().alias("task"))


def _log(x: str) -> str:
    return f"round(ln(1 + CAST(coalesce({x}, 0) AS DOUBLE)), 6)"


_KNOWN = ", ".join(f"'{x}'" for x in vectors.DOC_TYPES)
_LOW = "lower(coalesce(query, ''))"


@query(
    _J
    + _PROBED
    + ", w AS (SELECT j.*, first, second FROM j LEFT JOIN probed USING (sample_id)) SELECT sample_id, "
    + _list(
        *[f"coalesce({c}, 0)" for c in ("vds", "rds", "ses", "composite")],
        _hot(_TASK, features.TASKS),
        _hot("doc_type", vectors.DOC_TYPES),
        _on(f"coalesce(doc_type, '') NOT IN ({_KNOWN})"),
        _log("num_pages"),
        _log("length(query)"),
        _log(r"len(list_filter(regexp_split_to_array(coalesce(query, ''), '\s+'), lambda t: t <> ''))"),
        *[_on(f"contains({_LOW}, '{x}')") for x in vectors.QUERY_WORDS],
        *[_on(f"starts_with({_LOW}, '{x}')") for x in vectors.QUERY_STARTS],
        *[_on(f) for f in _FLAGS],
        _log(_ELEMENTS),
        _log("image_bytes_size"),
        "coalesce(tier, 0)",
        _on("first"),
        _on("second"),
        _on(f"{_AGREE} = 'both_correct'"),
        _on(f"{_AGREE} = 'both_wrong'"),
    )
    + " AS features FROM w"
)
def router_vectors(spark: S, d: str) -> DataFrame:
    return router_rows(spark, d).select("sample_id", F.col("x").alias("features"))


@query(
    _J
    + "SELECT sample_id, "
    + _list(*[f"coalesce({c}, 0)" for c in ("vds", "rds", "ses", "tier")], *[_on(f) for f in _FLAGS[:3]], _hot(_TASK, features.TASKS))
    + " AS long_form, "
    + _list("coalesce(tier, 0)", *[_on(f) for f in _FLAGS[:3]], _hot(_TASK, features.TASKS))
    + " AS plain_form, "
    + _list("coalesce(tier, 0) / 3.0", *[_on(f) for f in _FLAGS], _hot(f"CASE WHEN {_TASK} IN ('T1','T2','T3','T4','T5','T6') THEN {_TASK} ELSE 'T1' END", features.TASKS))
    + " AS short_form FROM j"
)
def completion_samples(spark: S, d: str) -> DataFrame:
    """The three forms of sample features that completion studies use."""
    j = _joined(spark, d, "task_type", *_FLAGS)
    flags = [F.col(f) for f in _FLAGS]
    return j.select("sample_id", *[vectors.completion_sample(_scores(), F.col("tier"), flags[:3], _task(), probes).alias(n) for probes, n in ((True, "long_form"), (False, "plain_form"))], vectors.short_sample(F.col("tier"), flags, _task()).alias("short_form"))


@query(
    "SELECT config_id, list_concat([CAST(ascii(tier) - 64 AS DOUBLE), round(ln(1 + cost_per_1m_reasoning), 6), round(ln(1 + CAST(budget_tokens AS DOUBLE)), 6)], list_transform((SELECT list(DISTINCT provider ORDER BY provider) FROM model_configs), lambda p: CASE WHEN p = provider THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS features FROM model_configs",
    base=False,
)
def completion_configs(spark: S, d: str) -> DataFrame:
    """Features of the configurations, their providers in alphabetical order."""
    c = table(spark, d, "model_configs")
    names = [r[0] for r in c.where("provider is not null").select("provider").distinct().orderBy("provider").collect()]
    return c.select("config_id", vectors.completion_config(F.ascii("tier") - 64, F.col("cost_per_1m_reasoning"), F.col("budget_tokens"), F.col("provider"), names).alias("features"))


@query(", g AS (SELECT sample_id, vds, rds, ses FROM notes WHERE vds IS NOT NULL AND rds IS NOT NULL AND ses IS NOT NULL) SELECT sample_id, round(pow(vds + 1e-6, 0.3) * pow(rds + 1e-6, 0.45) * pow(ses + 1e-6, 0.25), 6) AS power, round((vds - 1) / CAST(3 AS DOUBLE), 6) AS scaled FROM g")
def power_composites(spark: S, d: str) -> DataFrame:
    g = notes(spark, d, "vds", "rds", "ses").where("vds is not null and rds is not null and ses is not null")
    return g.select("sample_id", F.round(vectors.power_composite(_scores(), (0.3, 0.45, 0.25)), 6).alias("power"), F.round(vectors.rescaled(F.col("vds").cast("double")), 6).alias("scaled"))


@query("SELECT result_id, CASE WHEN reasoning_tokens <= 0 THEN 0 WHEN reasoning_tokens <= 1024 THEN 1024 WHEN reasoning_tokens <= 4096 THEN 4096 ELSE 16384 END AS budget FROM (SELECT result_id, arg_max(reasoning_tokens, ingested_at) AS reasoning_tokens FROM eval_results WHERE reasoning_tokens IS NOT NULL GROUP BY 1)", base=False)
def budget_of_tokens(spark: S, d: str) -> DataFrame:
    """The budget that the logarithm of the tokens used asks for."""
    from ..operators.results import last_by

    e = last_by(table(spark, d, "eval_results").where("reasoning_tokens is not null"), ["result_id"], ["ingested_at"], ["reasoning_tokens"])
    # A predictor gives a logarithm; half a token less keeps whole counts on their side of a bound.
    return e.select("result_id", vectors.budget_for(F.log1p(F.col("reasoning_tokens") - 0.5), (0, 1024, 4096, 16384)).alias("budget"))

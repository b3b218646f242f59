"""Feature vectors of samples and configurations for selection, completion and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import TASKS, WEIGHTS, flag, one_hot
from .scores import number
from .text import canonical_name, strip, word_count

#: The sixteen sources, in their order in the sample embedding.
SOURCES = ("RVL-CDIP", "FUNSD", "CORD", "SROIE", "TextVQA", "ST-VQA", "HierText", "PubLayNet", "DocVQA", "InfographicVQA", "ChartQA", "TabFact", "WikiTableQuestions", "VisualMRC", "MP-DocVQA", "SlideVQA")
#: Document types, words and first words of queries that router features tell apart.
DOC_TYPES = ("academic_paper", "chart", "document", "infographic", "presentation", "receipt", "scene_text", "table", "webpage", "form")
QUERY_WORDS = ("compare", "across", "locate", "total", "how many", "all", "table", "chart")
QUERY_STARTS = ("what", "where", "how", "which", "is")
#: Answers of two classes, metrics whose answers may be numbers, and bounds of the complexity bins.
YES_NO = ("yes", "no", "true", "false")
NUMERIC_METRICS = ("exact_match", "denotation")
TEXT_METRICS = ("anls", "vqa_accuracy", "slidevqa_em", "rouge_cider")
BINS = (2.0, 3.0)


def on(condition: Column) -> Column:
    """1 where a condition holds, else 0, also for null."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def log_length(x: Column) -> Column:
    """The logarithm of a count plus one, 0 for null."""
    return F.round(F.log1p(F.coalesce(x, F.lit(0)).cast("double")), 6)


def sample_embedding(task: Column, tier: Column, source: Column, scores: Sequence[Column], table: Column, chart: Column) -> Column:
    """30 numbers: task (6), tier (3), source (16), three scores over 4, two flags.

    Sources are told apart without case, spaces, hyphens and underscores; a null tier counts as 2,
    null scores as 2, 2 and 1; unknown categories are all 0.
    """
    known = F.coalesce(tier, F.lit(2)).cast("string")
    names = [x.lower().replace("-", "") for x in SOURCES]
    scaled = [F.coalesce(s, F.lit(d)) / 4.0 for s, d in zip(scores, (2, 2, 1), strict=True)]
    return F.concat(one_hot(task, TASKS), one_hot(known, ("1", "2", "3")), one_hot(canonical_name(source), names), F.array(*scaled), F.array(on(table), on(chart)))


def quality_features(scores: Sequence[Column], table: Column, chart: Column, query: Column) -> Column:
    """6 numbers: three scores over 4 (null as 2), two flags by halves, and the query's length over 100."""
    return F.array(*[F.coalesce(s, F.lit(2)) / 4.0 for s in scores], on(table) * 0.5, on(chart) * 0.5, F.coalesce(F.length(query), F.lit(0)) / 100.0)


def answer_type(metric: Column, gold: Column) -> Column:
    """``boolean``, ``numeric``, ``abstractive`` (more than five words) or ``extractive``, by metric and gold answer.

    Answers of metrics that compare classes or sets are never abstractive; those of fields, tables
    and boxes are always extractive.
    """
    name, g = F.coalesce(metric, F.lit("")), F.lower(strip(F.coalesce(gold, F.lit(""))))
    value = number(F.regexp_replace(g, "[,%]", ""))
    short = F.when(g.isin(*YES_NO), "boolean").when(value.isNotNull(), "numeric")
    return (
        F.when(name.isin(*NUMERIC_METRICS), F.coalesce(short, F.lit("extractive")))
        .when(name.isin(*TEXT_METRICS), F.coalesce(short, F.when(word_count(g) > 5, "abstractive").otherwise("extractive")))
        .otherwise("extractive")
    )


def complexity_bin(scores: Sequence[Column]) -> Column:
    """``low``, ``medium`` or ``high`` by the weighted scores, null ones as 2."""
    total = sum((w * F.coalesce(s, F.lit(2)).cast("double") for w, s in zip(WEIGHTS[1:], scores[1:], strict=True)), WEIGHTS[0] * F.coalesce(scores[0], F.lit(2)).cast("double"))
    return F.when(F.round(total, 9) < BINS[0], "low").when(F.round(total, 9) < BINS[1], "medium").otherwise("high")


def probe_agreement(first: Column, second: Column) -> Column:
    """``missing`` without any outcome, ``both_correct``, ``both_wrong``, else ``disagree``, one missing outcome too."""
    return F.when(first.isNull() & second.isNull(), "missing").when(first.eqNullSafe(second), F.when(first, "both_correct").otherwise("both_wrong")).otherwise("disagree")


def diversity_tuple(task: Column, source: Column, doc_type: Column, flags: Sequence[Column], elements: Column, kind: Column, complexity: Column, agreement: Column) -> Column:
    """Eleven categories as text: what the greedy diverse selection compares; null is ''."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (task, source, doc_type)]
    return F.array(*text, *[on(f).cast("int").cast("string") for f in flags], F.least(F.coalesce(elements, F.lit(0)), F.lit(3)).cast("string"), *[F.coalesce(c, F.lit("")) for c in (kind, complexity, agreement)])


def router_features(row: dict[str, Column]) -> Column:
    """48 numbers that routers learn from.

    ``row`` has the columns vds, rds, ses, composite, task, doc_type, num_pages, query, has_table,
    has_chart, has_figure, has_handwriting, elements, image_bytes, tier, first and second (outcomes
    of the two probes).  Nulls count as 0 or false.
    """
    def plain(name: str) -> Column:
        return F.coalesce(row[name].cast("double"), F.lit(0.0))

    query = F.coalesce(row["query"], F.lit(""))
    low = F.lower(query)
    agreement = probe_agreement(row["first"], row["second"])
    kind = row["doc_type"]
    return F.concat(
        F.array(*[plain(c) for c in ("vds", "rds", "ses", "composite")]),
        one_hot(row["task"], TASKS),
        one_hot(kind, DOC_TYPES),
        F.array(1.0 - on(kind.isin(*DOC_TYPES)), log_length(row["num_pages"]), log_length(F.length(query)), log_length(word_count(query))),
        F.array(*[on(F.contains(low, F.lit(w))) for w in QUERY_WORDS], *[on(low.startswith(w)) for w in QUERY_STARTS]),
        F.array(*[on(row[c]) for c in ("has_table", "has_chart", "has_figure", "has_handwriting")], log_length(row["elements"]), log_length(row["image_bytes"]), plain("tier")),
        F.array(on(row["first"]), on(row["second"]), on(agreement == "both_correct"), on(agreement == "both_wrong")),
    )


def completion_sample(scores: Sequence[Column], tier: Column, flags: Sequence[Column], task: Column, probes: bool = True) -> Column:
    """13 numbers of a sample for completion: scores, tier, three flags, task; 10 without the probes' scores."""
    plain = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in [*(scores if probes else ()), tier]]
    return F.concat(F.array(*plain, *[on(f) for f in flags]), one_hot(task, TASKS))


def short_sample(tier: Column, flags: Sequence[Column], task: Column) -> Column:
    """11 numbers of a sample for hold-out studies: tier over 3, four flags, task; an unknown task counts as the first."""
    known = F.when(task.isin(*TASKS), task).otherwise(TASKS[0])
    return F.concat(F.array(F.coalesce(tier.cast("double"), F.lit(0.0)) / 3.0, *[on(f) for f in flags]), one_hot(known, TASKS))


def completion_config(tier: Column, rate: Column, budget: Column, provider: Column, providers: Sequence[str]) -> Column:
    """Numbers of a configuration: tier, logarithms of rate and budget, and its provider of those listed."""
    return F.concat(F.array(tier.cast("double"), log_length(rate), log_length(budget)), one_hot(provider, providers))


def scaled_config(tier: Column, rate: Column, budget: Column, provider: Column, providers: Sequence[str]) -> Column:
    """:func:`completion_config` with the tier over 3 and the logarithm of the budget over 10, for studies across configurations."""
    return F.concat(F.array(tier / 3.0, log_length(rate), log_length(budget) / 10.0), one_hot(provider, providers))


def power_composite(values: Sequence[Column], exponents: Sequence[float]) -> Column:
    """The product of powers of three scores, each raised by a millionth."""
    out = F.lit(1.0)
    for v, e in zip(values, exponents, strict=True):
        out = out * F.pow(v.cast("double") + 1e-6, F.lit(float(e)))
    return out


def exponent_order(exponents: Column) -> Column:
    """Places of an array of exponents from the largest on, the first on a tie."""
    return F.transform(F.array_sort(F.transform(exponents, lambda e, i: F.struct((-e).alias("e"), i.alias("i")))), lambda x: x["i"])


def rescaled(score: Column, low: float = 1.0, high: float = 4.0) -> Column:
    """A score between two bounds on the scale 0 to 1."""
    return (score - low) / (high - low)


def budget_for(log_tokens: Column, budgets: Sequence[int]) -> Column:
    """The smallest budget that holds as many tokens as a logarithm predicts, the largest if none does."""
    tokens = F.exp(log_tokens) - 1
    listed = F.array(*map(F.lit, sorted(budgets)))
    return F.coalesce(F.get(F.filter(listed, lambda b: b >= tokens), 0), F.lit(max(budgets)))

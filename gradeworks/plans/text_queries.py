"""Queries over texts: scorers, extraction, features and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, scores, text
from ..functions import text as text_functions
from ..sources.tables import table
from .base import query, runs, samples

S = SparkSession

_PAIR = """, graded AS (SELECT r.result_id, r.predicted_answer AS p, s.gt_answer AS g, s.source_dataset AS src, s.query AS q, lower(s.correctness_metric) AS m,
 list_distinct(list_filter(list_concat([s.gt_answer], coalesce(s.gt_answer_aliases, [])), lambda x: x IS NOT NULL)) AS refs
 FROM runs r JOIN samples s USING (sample_id) WHERE r.result_type = 'observed' AND r.predicted_answer IS NOT NULL AND s.gt_answer IS NOT NULL)
"""


def _graded(spark: S, d: str, distinct: bool = True) -> DataFrame:
    r = runs(spark, d, "sample_id", "result_type", "predicted_answer").where("result_type = 'observed' and predicted_answer is not null").select("result_id", "sample_id", F.col("predicted_answer").alias("p"))
    s = samples(spark, d, "gt_answer", "gt_answer_aliases", "source_dataset", "query", "correctness_metric").where("gt_answer is not null")
    given = scores.answers(F.col("gt_answer"), F.col("gt_answer_aliases"))
    refs = F.array_distinct(given) if distinct else given
    return r.join(s.select("sample_id", F.col("gt_answer").alias("g"), F.col("source_dataset").alias("src"), F.col("query").alias("q"), F.lower("correctness_metric").alias("m"), refs.alias("refs")), "sample_id")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SQUEEZE = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query()
def score_anls(spark: S, d: str) -> DataFrame:
    """Edit distances are over characters; SQL engines count bytes, so tests compare with brute force."""
    g = _graded(spark, d).where("m = 'anls'")
    return g.select("result_id", F.round(scores.anls(F.col("p"), F.col("refs")), 6).alias("score"))


def _label(t: str) -> str:
    base = f"lower({_SQUEEZE.format(t)})"
    claims = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scores.CLAIMS.items())
    classes = " ".join(f"WHEN '{i}' THEN '{v}'" for i, v in enumerate(scores.CLASSES))
    kind = r"regexp_replace(lower(coalesce(src,'')), '[\s\-_]+', '', 'g')"
    return f"CASE {kind} WHEN 'tabfact' THEN CASE {base} {claims} ELSE {base} END WHEN 'rvlcdip' THEN CASE {base} {classes} ELSE {base} END ELSE {base} END"


@query(_PAIR + f"SELECT result_id, list_bool_or(list_transform(refs, lambda r: {_label('p')} = {_label('r')})) AS correct FROM graded WHERE m = 'exact_match'")
def score_exact_match(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'exact_match'")
    return g.select("result_id", scores.exact(F.col("p"), F.col("refs"), F.col("src")).alias("correct"))


_NUM = scores.NUMBER


def _relaxed_number(t: str) -> str:
    clean = rf"regexp_replace(regexp_replace({t}, '%\s*$', ''), '[$€£,\s]', '', 'g')"
    return f"CASE WHEN regexp_matches({clean}, '{_NUM}') THEN CAST({clean} AS DOUBLE) END"


@query(_PAIR + f"""SELECT result_id, list_bool_or(list_transform(refs, lambda r: CASE WHEN lower({_STRIP.format('p')}) IN ('n/a','na','none','null','-','') OR lower({_STRIP.format('r')}) IN ('n/a','na','none','null','-','') THEN false
 WHEN {_relaxed_number('p')} IS NOT NULL AND {_relaxed_number('r')} IS NOT NULL THEN abs({_relaxed_number('p')} - {_relaxed_number('r')}) / greatest(abs({_relaxed_number('r')}), 1e-9) < 0.05
 ELSE contains(lower({_STRIP.format('r')}), lower({_STRIP.format('p')})) OR contains(lower({_STRIP.format('p')}), lower({_STRIP.format('r')})) END)) AS correct FROM graded WHERE m = 'relaxed_accuracy'""")
def score_relaxed(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'relaxed_accuracy'")
    return g.select("result_id", scores.relaxed(F.col("p"), F.col("refs")).alias("correct"))


def _slide_number(t: str) -> str:
    clean = _STRIP.format(f"regexp_replace({t}, '[,$€£%~]', '', 'g')")
    return f"CASE WHEN regexp_matches({clean}, '{_NUM}') THEN CAST({clean} AS DOUBLE) END"


@query(_PAIR + f"""SELECT result_id, CASE WHEN {_slide_number('p')} IS NOT NULL AND {_slide_number('g')} IS NOT NULL THEN
 CASE WHEN {_slide_number('g')} = 0 THEN abs({_slide_number('p')}) <= 0.05 ELSE abs({_slide_number('p')} - {_slide_number('g')}) <= 0.05 * abs({_slide_number('g')}) END
 ELSE lower({_STRIP.format('p')}) = lower({_STRIP.format('g')}) END AS correct FROM graded WHERE m = 'slidevqa_em'""")
def score_slide(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'slidevqa_em'")
    return g.select("result_id", scores.slide(F.col("p"), F.col("g"), F.col("q")).alias("correct"))


#: The ASCII punctuation marks as a character class in a SQL string.
_MARKS = scores.PUNCTUATION.replace("'", "''")


def _bag(t: str) -> str:
    plain = f"regexp_replace(lower(regexp_replace({t}, '[$€£¥₹,]', '', 'g')), '{_MARKS}', '', 'g')"
    return f"list_filter(string_split({_SQUEEZE.format(plain)}, ' '), lambda w: w <> '')"


def _leaves(t: str) -> str:
    """The leaf values of JSON with spaces between; any other text as it is."""
    told = "CASE j.type WHEN 'NULL' THEN '' WHEN 'BOOLEAN' THEN CASE WHEN CAST(j.atom AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string(j.atom, '$') END"
    is_json = f"(regexp_matches({t}, '^\\s*[\\[{{]') AND json_valid({t}))"
    return f"CASE WHEN {is_json} THEN coalesce((SELECT string_agg({told}, ' ' ORDER BY j.id) FROM json_tree(CASE WHEN {is_json} THEN {t} ELSE 'null' END) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')), '') ELSE {t} END"


@query(_PAIR + f""", plain AS (SELECT result_id, {_leaves('p')} AS p, {_leaves('g')} AS g FROM graded WHERE m = 'field_f1'), bags AS (SELECT result_id, {_bag('p')} AS a, {_bag('g')} AS b FROM plain),
 s AS (SELECT result_id, len(a) AS x, len(b) AS y, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))) AS c FROM bags)
SELECT result_id, round(CASE WHEN x = 0 AND y = 0 THEN 1.0 WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE 2.0 * c / (x + y) END, 6) AS score FROM s""")
def score_field_f1(spark: S, d: str) -> DataFrame:
    """Every pair; of JSON the words of the leaves count."""
    g = _graded(spark, d).where("m = 'field_f1'").withColumns({c: scores.leaf_text(F.col(c)) for c in ("p", "g")})
    return g.select("result_id", F.round(scores.bag_f1(scores.plain_words(F.col("p")), scores.plain_words(F.col("g"))), 6).alias("score"))


def _box(t: str) -> str:
    return f"list_transform(list_slice(regexp_extract_all({t}, '[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?'), 1, 4), lambda x: CAST(x AS DOUBLE))"


@query(_PAIR + f""", b AS (SELECT result_id, {_box('p')} AS a, {_box('g')} AS b FROM graded WHERE m = 'iou'),
 v AS (SELECT result_id, CASE WHEN len(a) = 4 AND a[1] >= -1e-6 AND a[2] >= -1e-6 AND a[3] <= 1 + 1e-6 AND a[4] <= 1 + 1e-6 AND a[3] > a[1] AND a[4] > a[2] THEN a END AS a,
  CASE WHEN len(b) = 4 AND b[1] >= -1e-6 AND b[2] >= -1e-6 AND b[3] <= 1 + 1e-6 AND b[4] <= 1 + 1e-6 AND b[3] > b[1] AND b[4] > b[2] THEN b END AS b FROM b),
 i AS (SELECT result_id, a, b, greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) AS x FROM v)
SELECT result_id, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE round(x / ((a[3]-a[1])*(a[4]-a[2]) + (b[3]-b[1])*(b[4]-b[2]) - x), 6) END AS score FROM i""")
def score_iou(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'iou'")
    return g.select("result_id", F.round(scores.iou(F.col("p"), F.array("g")), 6).alias("score"))


@query()
def score_rouge_l(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'rouge_cider'")
    return g.select("result_id", F.round(scores.rouge_l("p", "refs"), 6).alias("score"))


@query()
def score_denotation(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'denotation'")
    return g.select("result_id", scores.denotation(F.col("p"), F.col("refs")).alias("correct"))


def _spoken(t: str) -> str:
    number = f"CAST(w AS DOUBLE)"
    scale = f"pow(10.0, 5 - floor(log10(abs({number}))))"
    short = f"CASE WHEN {number} = floor({number}) THEN printf('%.0f', {number}) ELSE CAST(round_even({number} * {scale}, 0) / {scale} AS VARCHAR) END"
    plain = "regexp_replace(w, '[^\\p{L}\\p{N}_\\s]', ' ', 'g')"
    words = f"list_transform(regexp_split_to_array(lower({_STRIP.format(t)}), '\\s+'), lambda w: CASE WHEN regexp_matches(w, '{_NUM}') THEN [{short}] ELSE regexp_split_to_array({_SQUEEZE.format(plain)}, '\\s+') END)"
    return f"array_to_string(list_filter(flatten({words}), lambda v: v NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f""", given AS (SELECT r.result_id, r.predicted_answer AS p, list_filter(list_concat([s.gt_answer], coalesce(s.gt_answer_aliases, [])), lambda x: x IS NOT NULL) AS refs
 FROM runs r JOIN samples s USING (sample_id) WHERE r.result_type = 'observed' AND r.predicted_answer IS NOT NULL AND s.gt_answer IS NOT NULL AND lower(s.correctness_metric) = 'vqa_accuracy'),
 spoken AS (SELECT result_id, {_spoken('p')} AS said, list_transform(refs, lambda r: {_spoken('r')}) AS asked FROM given),
 told AS (SELECT result_id, len(list_filter(asked, lambda a: a = said)) AS same, len(asked) AS n FROM spoken)
SELECT result_id, round(least(same / 3.0, 1.0), 6) AS score, n > 0 AND same >= least(3, n) AS correct FROM told""")
def score_vqa(spark: S, d: str) -> DataFrame:
    """Every answer given counts, repeated ones too; with fewer than three all must agree."""
    g = _graded(spark, d, distinct=False).where("m = 'vqa_accuracy'")
    return g.select("result_id", F.round(scores.vqa(F.col("p"), F.col("refs")), 6).alias("score"), scores.vqa_correct(F.col("p"), F.col("refs")).alias("correct"))


@query()
def score_tables(spark: S, d: str) -> DataFrame:
    g = _graded(spark, d).where("m = 'teds'")
    return g.select("result_id", F.round(scores.table_similarity("p", "g"), 6).alias("score"))


@query()
def grade_answers(spark: S, d: str) -> DataFrame:
    """Every run under its sample's own metric."""
    r = runs(spark, d, "sample_id", "result_type", "predicted_answer", "is_correct").where("result_type = 'observed'").select("result_id", "sample_id", "predicted_answer", "is_correct")
    s = samples(spark, d, "gt_answer", "gt_answer_aliases", "source_dataset", "query", "correctness_metric").select("sample_id", "gt_answer", "gt_answer_aliases", "correctness_metric", "source_dataset", "query")
    graded = scores.is_correct(*[F.col(c) for c in ("correctness_metric", "predicted_answer", "gt_answer", "gt_answer_aliases", "source_dataset", "query")])
    return r.join(s.where("correctness_metric is not null"), "sample_id").select("result_id", "is_correct", graded.alias("graded"))


def _extracted() -> str:
    text = _STRIP.format("regexp_replace(" + _STRIP.format("regexp_replace(coalesce(predicted_answer, ''), '<think>.*?</think>', '', 'gis')") + r", '\*\*|__', '', 'g')")
    forms = (r"^(?:the\s+)?(?:final\s+)?answer\s*(?:is\s*:?|:)\s*", r"^ans(?:wer)?\s*:\s*", r"^a\s*:\s*", r"^looking at (?:the )?[^,]{1,60},\s*", r"^(?:based on|according to) [^,]{1,60},\s*", r"^(?:it is|this is|that is)\s+", r"^result\s*:\s*")
    bare = "line"
    for form in forms:
        bare = f"regexp_replace({bare}, '{form}', '', 'i')"
    listed = f"list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
    binary = ", ".join(f"'{b}'" for b in text_functions.BINARY)
    head = _STRIP.format("regexp_extract(bare, '^([^,.;!?]*)[,.;!?]', 1)")
    return f""", raw AS (SELECT result_id, {text} AS t FROM runs WHERE result_type = 'observed'),
 lines AS (SELECT result_id, CASE WHEN starts_with(t, '{{') AND json_valid(t) THEN json_extract_string(t, '$.answer') END AS boxed, coalesce({listed}[1], '') AS line FROM raw),
 bares AS (SELECT result_id, boxed, {_STRIP.format(bare)} AS bare FROM lines)
SELECT result_id, regexp_replace(coalesce(boxed, CASE WHEN lower({head}) IN ({binary}) THEN {head} ELSE bare END), '^["''`]+|["''`]+$', '', 'g') AS answer FROM bares"""


@query(_extracted())
def extracted_answers(spark: S, d: str) -> DataFrame:
    r = runs(spark, d, "result_type", "predicted_answer").where("result_type = 'observed'")
    return r.select("result_id", text.extract_answer(F.col("predicted_answer")).alias("answer"))


@query(r"SELECT sample_id, len(list_filter(regexp_split_to_array(coalesce(query, ''), '\s+'), lambda w: w <> '')) AS words FROM samples")
def query_words(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "query").select("sample_id", text.word_count(F.col("query")).cast("long").alias("words"))


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(query, '')), '{w}')" for w in words) + ")"


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(query, ''), '\s+'), lambda w: w <> ''))"
_PRIOR = f"""SELECT sample_id, CASE WHEN has_chart AND has_figure THEN 4 WHEN has_chart OR has_figure THEN 3 WHEN {_any(features.PLACES)} THEN 2 ELSE 1 END AS vds,
 CASE WHEN {_any(features.SEVERAL)} THEN 4 WHEN {_any(features.CALCULATION)} THEN 3 WHEN {_WORDS} < 8 THEN 1 ELSE 2 END AS rds,
 CASE WHEN coalesce(num_pages, 1) > 1 THEN 4 WHEN (has_table AND has_figure) OR {_any(features.SPANS)} THEN 3 WHEN has_table OR has_figure THEN 2 ELSE 1 END AS ses,
 regexp_replace(lower(coalesce(source_dataset, '')), '[\\s\\-_]+', '', 'g') AS src, {_any(features.CALCULATION)} AS counts FROM samples"""


@query(f", raw AS ({_PRIOR}) SELECT sample_id, vds, rds, ses, CAST(round(0.30*vds + 0.45*rds + 0.25*ses, 4) AS DOUBLE) AS composite FROM raw")
def prior_scores(spark: S, d: str) -> DataFrame:
    s = samples(spark, d, "query", "has_chart", "has_figure", "has_table", "num_pages").select("sample_id", features.visual_score().alias("vds"), features.reasoning_score().alias("rds"), features.extent_score().alias("ses"))
    return s.withColumn("composite", features.composite(F.col("vds"), F.col("rds"), F.col("ses")))


@query(f""", raw AS ({_PRIOR}), t AS (SELECT *, CASE WHEN round(0.30*vds + 0.45*rds + 0.25*ses, 4) < 2.2 THEN 1 WHEN round(0.30*vds + 0.45*rds + 0.25*ses, 4) < 3.0 THEN 2 ELSE 3 END AS t0 FROM raw)
SELECT sample_id, CASE WHEN src = 'tabfact' THEN greatest(rds, 2) WHEN src IN ('wtq', 'wikitablequestions') THEN greatest(rds, 3) ELSE rds END AS rds_est,
 CASE WHEN src = 'mpdocvqa' THEN 4 ELSE ses END AS ses_est,
 CASE WHEN src = 'rvlcdip' THEN 1 WHEN src = 'mpdocvqa' THEN greatest(t0, 2) WHEN src = 'slidevqa' AND counts THEN greatest(t0, 2) WHEN src IN ('slidevqa', 'cord', 'sroie') THEN least(t0, 2) ELSE t0 END AS tier_prior FROM t""")
def prior_tiers(spark: S, d: str) -> DataFrame:
    p = samples(spark, d, "query", "has_chart", "has_figure", "has_table", "num_pages", "source_dataset").select("sample_id", "source_dataset", "query", features.visual_score().alias("v"), features.reasoning_score().alias("r"), features.extent_score().alias("s"))
    tier = features.tier_of(features.composite(F.col("v"), F.col("r"), F.col("s")))
    _, rds, ses, out = features.source_rules(F.col("v"), F.col("r"), F.col("s"), tier, F.col("source_dataset"), F.col("query"))
    return p.select("sample_id", rds.alias("rds_est"), ses.alias("ses_est"), out.alias("tier_prior"))


def _soft() -> str:
    def num(x: float) -> str:
        return f"CAST({x} AS DOUBLE)"

    low, high = map(num, features.BOUNDS)
    (a1, b1, c1), (f2, m2, l2), (c3, b3, a3) = (tuple(map(num, features.BASE[t])) for t in (1, 2, 3))

    def top(own: str, distance: str) -> str:
        return f"least({num(0.95)}, greatest({num(0.5)}, {own} + least({num(0.1)}, greatest({num(-0.1)}, ({distance}) * {num(0.1)}))))"

    def move(gap: str) -> str:
        return f"CASE WHEN {gap} < 0.5 THEN least({num(0.1)}, ({num(0.5)} - ({gap})) * {num(0.2)}) ELSE {num(0)} END"

    def part(which: str, share: str) -> str:
        return f"round((1.0 - {which}) * ({share}), 4)"

    raised = ", ".join(f"CASE WHEN {m} > 0 THEN least({num(0.4)}, {b} + {m}) ELSE {b} END AS {n}" for m, b, n in (("to_low", f2, "first"), ("to_high", l2, "last")))
    return f""", p AS ({_PRIOR}), c AS (SELECT sample_id, CAST(round(0.30*vds + 0.45*rds + 0.25*ses, 4) AS DOUBLE) AS s FROM p),
 t AS (SELECT *, CASE WHEN s < {low} THEN 1 WHEN s < {high} THEN 2 ELSE 3 END AS tier, {top(a1, f"{low} - s")} AS top1, {top(a3, f"s - {high}")} AS top3, {move(f"s - {low}")} AS to_low, {move(f"{high} - s")} AS to_high FROM c),
 u AS (SELECT *, {raised}, CASE WHEN to_low > 0 THEN greatest({num(0.4)}, {m2} - to_low) ELSE {m2} END AS once FROM t),
 v AS (SELECT *, CASE WHEN to_high > 0 THEN greatest({num(0.4)}, once - to_high) ELSE once END AS middle FROM u),
 w AS (SELECT sample_id, tier, CASE tier WHEN 1 THEN [top1, {part("top1", f"{b1} / ({b1} + {c1})")}, {part("top1", f"{c1} / ({b1} + {c1})")}] WHEN 2 THEN [first, middle, last]
  ELSE [{part("top3", f"{c3} / ({b3} + {c3})")}, {part("top3", f"{b3} / ({b3} + {c3})")}, top3] END AS x FROM v),
 y AS (SELECT sample_id, tier, [round(x[1] / (x[1] + x[2] + x[3]), 4), round(x[2] / (x[1] + x[2] + x[3]), 4), round(x[3] / (x[1] + x[2] + x[3]), 4)] AS q FROM w)
SELECT sample_id, tier, [round(q[i] + CASE WHEN i = list_position(q, list_max(q)) THEN round(1.0 - (q[1] + q[2] + q[3]), 4) ELSE 0 END, 4) FOR i IN [1, 2, 3]] AS soft FROM y"""


@query(_soft())
def soft_tiers(spark: S, d: str) -> DataFrame:
    """Chances of the three tiers from the prior scores."""
    c = features.composite(F.col("vds"), F.col("rds"), F.col("ses"))
    p = prior_scores(spark, d).withColumn("tier", features.tier_of(c))
    return p.select("sample_id", "tier", features.soft_tiers(F.col("tier"), F.col("composite")).alias("soft"))


@query("SELECT sample_id, [CASE WHEN upper(trim(task_type)) = t THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FOR t IN ['T1','T2','T3','T4','T5','T6']] AS one_hot FROM samples")
def task_vectors(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "task_type").select("sample_id", features.one_hot(F.upper(F.trim("task_type")), features.TASKS).alias("one_hot"))


@query("SELECT result_id, round(coalesce(input_tokens,0)/1e6*cost_per_1m_input + coalesce(output_tokens,0)/1e6*cost_per_1m_output + coalesce(reasoning_tokens,0)/1e6*cost_per_1m_reasoning, 8) AS expected_cost FROM runs JOIN model_configs USING (config_id)")
def token_costs(spark: S, d: str) -> DataFrame:
    j = runs(spark, d, "config_id", "input_tokens", "output_tokens", "reasoning_tokens").join(table(spark, d, "model_configs"), "config_id")
    rates = [F.col(f"cost_per_1m_{k}") for k in ("input", "output", "reasoning")]
    return j.select("result_id", features.token_cost(rates, [F.col(f"{k}_tokens") for k in ("input", "output", "reasoning")]).alias("expected_cost"))


@query(r"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", base=False)
def json_fields(spark: S, d: str) -> DataFrame:
    leaves = text.json_leaves(F.col("props"))
    return table(spark, d, "events").select("event_id", leaves["k"].cast("long").alias("k"))


@query(r"SELECT sample_id, regexp_extract(lower(image_path), '\.([a-z0-9]+)([?#].*)?$', 1) AS extension FROM samples WHERE image_path IS NOT NULL")
def image_extensions(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "image_path").where("image_path is not null").select("sample_id", F.regexp_extract(F.lower("image_path"), r"\.([a-z0-9]+)([?#].*)?$", 1).alias("extension"))


@query(r"""SELECT sample_id, alias FROM (SELECT sample_id, unnest(gt_answer_aliases) AS alias FROM samples) WHERE trim(alias) <> ''""")
def alias_rows(spark: S, d: str) -> DataFrame:
    return samples(spark, d, "gt_answer_aliases").select("sample_id", F.explode("gt_answer_aliases").alias("alias")).where(F.trim("alias") != "")

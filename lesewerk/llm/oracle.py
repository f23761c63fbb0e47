"""The same queries as plain SQL, for those that plain SQL can express on whole tables."""

from __future__ import annotations

_STATE = """
state AS (
  SELECT chunk_id, project_id, engine, saved_at, cer, speaker_similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(saved_at, TIMESTAMP '0001-01-01') DESC, project_id DESC, engine DESC NULLS LAST, cer DESC NULLS LAST) AS r
    FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1),
voice AS (SELECT id AS project_id, max(voice) AS voice FROM projects GROUP BY id)
"""
_CER = "CASE WHEN cer IS NOT NULL AND NOT isnan(cer) AND NOT isinf(cer) AND cer >= 0 THEN cer END"
_SIM = """CASE WHEN speaker_similarity IS NULL OR isnan(speaker_similarity) OR speaker_similarity < -1 OR speaker_similarity > 100 THEN NULL
          WHEN speaker_similarity > 1 THEN speaker_similarity / 100.0 ELSE speaker_similarity END"""


def _targets(value: str) -> str:
    return ", ".join(f"round(quantile_cont({value}, {p}), 6) AS {name}" for name, p in {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}.items())


def _by_group(value: str, groups: str) -> str:
    return f"""
WITH {_STATE}, m AS (
  SELECT s.project_id, engine, v.voice, CAST(saved_at AS DATE) AS day, round(({value}) / 0.001) * 0.001 AS x
  FROM state s LEFT JOIN voice v USING (project_id))
SELECT {groups}, count(*) AS n, CAST(0.0005 AS DOUBLE) AS error_bound, {_targets("x")} FROM m WHERE x IS NOT NULL GROUP BY {groups}
"""


SQL = {
    "p1_found": """
WITH lim AS (
  SELECT item_kind, lower(trim(engine)) AS engine, min(max_chars) AS max_chars FROM size_limits GROUP BY 1, 2),
sized AS (
  SELECT 'teil' AS item_kind, teil_id AS item_id, CAST(NULL AS VARCHAR) AS engine, length(text) AS n FROM teile
  UNION ALL SELECT 'chunk', chunk_id, lower(trim(engine)), length(raw_text) FROM chunks)
SELECT DISTINCT s.item_kind, s.item_id
FROM sized s LEFT JOIN lim a ON a.item_kind = s.item_kind AND a.engine = s.engine
  LEFT JOIN lim b ON b.item_kind = s.item_kind AND b.engine = '*'
WHERE s.item_id IS NOT NULL AND s.n > coalesce(a.max_chars, b.max_chars)
""",
    "p5_found": f"""
WITH {_STATE}, exact AS (
  SELECT project_id, median({_CER}) AS m FROM state GROUP BY project_id)
SELECT DISTINCT variant_id FROM variants LEFT JOIN exact USING (project_id)
WHERE status = 'done' AND median_cer IS NOT NULL AND (isnan(median_cer) OR m IS NULL OR round(abs(median_cer - m), 9) > 0.01)
""",
    "p5_cer": _by_group(_CER, "project_id, engine, voice, day"),
    "p5_similarity": _by_group(_SIM, "project_id, engine, voice, day"),
    "p5_similarity_by_voice": _by_group(_SIM, "voice"),
    "p5_variants": f"""
WITH v AS (SELECT DISTINCT variant_id, comparison_id, median_cer AS x FROM variants)
SELECT comparison_id, count(*) AS n, CAST(0 AS DOUBLE) AS error_bound, {_targets("x")}
FROM v WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AND x >= 0 GROUP BY comparison_id
""",
}

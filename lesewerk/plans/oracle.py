"""The queries in plain SQL, as a second, independent statement of what they return.

Queries without an entry can't be put into it: edit distances over letters beyond ASCII, rule chains whose replacements are
computed, and folds over a recording. The tests hold those against brute force and literal cases.
"""

from __future__ import annotations

_ONES = "['null','eins','zwei','drei','vier','fünf','sechs','sieben','acht','neun','zehn','elf','zwölf','dreizehn','vierzehn','fünfzehn','sechzehn','siebzehn','achtzehn','neunzehn']"
_TENS = "['','','zwanzig','dreißig','vierzig','fünfzig','sechzig','siebzig','achtzig','neunzig']"
_SPACE = r"[\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _current(*columns: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    return f"""cur AS (SELECT chunk_id, {", ".join(columns)} FROM (
      SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(saved_at, TIMESTAMP '0001-01-01') DESC, {order}) AS _r FROM chunks WHERE chunk_id IS NOT NULL) WHERE _r = 1)"""


_PROGRESS = f"""{_current("project_id", "status", "cer", "speaker_similarity")},
p AS (SELECT project_id, count(*) AS total, count(*) FILTER (status IN ('ok', 'needs_review')) AS done, count(*) FILTER (status IN ('needs_review', 'failed')) AS review,
  count(*) FILTER (status IN ('pending', 'failed')) AS open, bool_and(coalesce(status = 'ok', false)) AS complete,
  round(median(CASE WHEN NOT isnan(cer) AND cer >= 0 THEN cer END), 6) AS median_cer,
  round(median(CASE WHEN NOT isnan(speaker_similarity) THEN CASE WHEN speaker_similarity > 1 THEN speaker_similarity / 100 ELSE speaker_similarity END END), 6) AS median_similarity
  FROM cur GROUP BY project_id)"""


def _hundred(n: str, one: str) -> str:
    return f"""CASE WHEN {n} = 0 THEN '' WHEN {n} = 1 THEN '{one}' WHEN {n} < 20 THEN {_ONES}[({n}) + 1]
      ELSE (CASE WHEN ({n}) % 10 = 0 THEN '' WHEN ({n}) % 10 = 1 THEN 'einund' ELSE {_ONES}[({n}) % 10 + 1] || 'und' END) || {_TENS}[({n}) // 10 + 1] END"""


def _thousand(n: str, one: str) -> str:
    return f"""(CASE WHEN ({n}) >= 200 THEN {_ONES}[({n}) // 100 + 1] || 'hundert' WHEN ({n}) >= 100 THEN 'einhundert' ELSE '' END) || ({_hundred(f"(({n}) % 100)", one)})"""


def _cardinal(n: str) -> str:
    return f"""CASE WHEN ({n}) = 0 THEN 'null' ELSE (CASE WHEN ({n}) >= 1000 THEN ({_thousand(f"(({n}) // 1000)", "ein")}) || 'tausend' ELSE '' END) || ({_thousand(f"(({n}) % 1000)", "eins")}) END"""


_KEY = "coalesce(array_to_string(list_transform(list_sort(map_entries({0})), lambda e: e.key || '=' || CAST(CAST(round(e.value * 1000) AS BIGINT) AS VARCHAR)), ','), '')"
_FRAMES = "f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events)"


def _islands(condition: str, gap: int) -> str:
    return f"""{_FRAMES}, h AS (SELECT user_id, frame, CASE WHEN frame - lag(frame) OVER w - 1 < {gap} THEN 0 ELSE 1 END AS n FROM f WHERE {condition} WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT user_id, frame, sum(n) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM h),
r AS (SELECT user_id, min(frame) AS "start", max(frame) + 1 AS "end", count(*) AS frames FROM i GROUP BY user_id, run)"""


_REASON = f"""{_current("project_id", "normalized_text", "asr_text", "status")},
r AS (SELECT chunk_id, CASE WHEN coalesce(asr_text, '') = '' THEN 'keine Rückschrift -- vermutlich kein Sprachanteil'
  WHEN length(asr_text) < 5 THEN 'Rückschrift zu kurz -- ' || asr_text
  WHEN NOT (length(asr_text) / (length(normalized_text) / 14.0::DOUBLE) BETWEEN 7 AND 24) THEN 'Text passt nicht zur Länge -- Zeichen/s' END AS reason
  FROM cur WHERE status IN ('ok', 'needs_review', 'failed'))"""

_TITLE = f"""
WITH t AS (SELECT DISTINCT teil_id, text FROM teile),
l AS (SELECT teil_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM t),
s AS (SELECT teil_id, CAST(line_no AS INTEGER) AS line_no, {_strip("line")} AS x,
  regexp_replace(coalesce(lead(line) OVER (PARTITION BY teil_id, length(line) * 0 ORDER BY line_no), ''), '^{_SPACE}+', '') AS nxt FROM l),
h AS (SELECT *, regexp_extract(x, '^#{{1,6}}[ \\t]+(.+?)[ \\t]*#*$', 1) AS marked FROM s),
o AS (SELECT teil_id, line_no, CASE WHEN marked <> '' THEN marked
  WHEN x <> '' AND length(x) <= 70 AND NOT contains('.!?…:,;', right(x, 1)) AND NOT regexp_matches(x, '^\\p{{Ll}}') AND NOT regexp_matches(nxt, '^[\\p{{Ll}},;)]') THEN x END AS title FROM h)
SELECT * FROM o WHERE title IS NOT NULL
"""

SQL = {
    "project_progress": f"WITH {_PROGRESS} SELECT * FROM p",
    "overview_counts": f"""
WITH {_PROGRESS}, e AS (SELECT DISTINCT id AS project_id FROM projects)
SELECT count(*) AS projects, count(*) FILTER (complete) AS complete, count(*) - count(*) FILTER (complete) AS in_work,
  CAST(sum(total) AS BIGINT) AS chunks, CAST(sum(done) AS BIGINT) AS done, CAST(sum(review) AS BIGINT) AS review, CAST(sum(open) AS BIGINT) AS open
FROM e LEFT JOIN p USING (project_id)""",
    "chunk_search": f"""
WITH {_current("project_id", "status", "raw_text", "normalized_text", "asr_text")}
SELECT chunk_id, project_id, status, (SELECT count(*) FROM cur) AS total FROM cur WHERE status IN ('needs_review', 'failed')
  AND (contains(lower(coalesce(raw_text, '')), 'regen') OR contains(lower(coalesce(normalized_text, '')), 'regen') OR contains(lower(coalesce(asr_text, '')), 'regen'))""",
    "lage_lookup": f"""
WITH {_current("project_id", "lage")}, e AS (
  SELECT chunk_id, p.voice, coalesce(nullif(c.lage, ''), nullif(p.lage, ''), 'neutral') AS lage FROM cur c LEFT JOIN projects p ON p.id = c.project_id)
SELECT chunk_id, voice, e.lage, coalesce(w.lage, n.lage) AS voice_lage, CASE WHEN w.lage IS NULL THEN n.duration_s ELSE w.duration_s END AS reference_s,
  CASE WHEN w.lage IS NULL THEN n.chars_per_second ELSE w.chars_per_second END AS rate
FROM e LEFT JOIN voices w ON w.name = e.voice AND w.lage = e.lage LEFT JOIN voices n ON n.name = e.voice AND n.lage = 'neutral'""",
    "text_matches": f"""
WITH {_current("project_id", "teil_no", "chunk_index", "normalized_text", "audio_file")},
n AS (SELECT project_id, teil_no, normalized_text, row_number() OVER (PARTITION BY project_id, teil_no, normalized_text ORDER BY chunk_index) AS k FROM cur WHERE normalized_text IS NOT NULL),
o AS (SELECT project_id, teil_no, normalized_text, row_number() OVER (PARTITION BY project_id, teil_no, normalized_text ORDER BY chunk_index) AS k FROM cur
  WHERE normalized_text IS NOT NULL AND audio_file IS NOT NULL AND audio_file <> ''),
m AS (SELECT project_id, teil_no, o.k AS a, n.k AS b FROM o FULL JOIN n USING (project_id, teil_no, normalized_text, k))
SELECT project_id, teil_no, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS kept, count(*) FILTER (a IS NULL) AS new, count(*) FILTER (b IS NULL) AS removed FROM m GROUP BY project_id, teil_no""",
    "option_groups": f"""
SELECT {_KEY.format("grid_options")} AS options, model, lage, count(*) AS variants, count(DISTINCT comparison_id) AS comparisons FROM variants GROUP BY 1, 2, 3""",
    "merged_options": """
WITH x AS (SELECT v.variant_id, v.grid_options AS n, p.engine_options AS o FROM variants v JOIN projects p ON p.id = v.project_id),
k AS (SELECT variant_id, n, o, unnest(list_distinct(list_concat(coalesce(map_keys(n), []), coalesce(map_keys(o), [])))) AS key FROM x)
SELECT variant_id, key, coalesce(n[key], o[key]) AS value FROM k""",
    "cleaned_options": """
WITH k AS (SELECT id, unnest(map_keys(engine_options)) AS key, unnest(map_values(engine_options)) * 1.3 AS v FROM projects)
SELECT id, key, CASE key WHEN 'speed' THEN least(greatest(v, 0.5), 1.5) ELSE round_even(least(greatest(v, 8), 64), 0) END AS value FROM k WHERE key IN ('speed', 'nfe_step') AND v IS NOT NULL AND NOT isnan(v)""",
    "best_variants": """
WITH x AS (SELECT *, CASE WHEN status = 'done' AND NOT isnan(median_cer) THEN median_cer END AS c, CASE WHEN status = 'done' AND NOT isnan(median_similarity) THEN median_similarity END AS s FROM variants)
SELECT variant_id, comparison_id,
  coalesce(c = min(c) OVER w AND min(c) OVER w < max(c) OVER w, false) AS best_cer, coalesce(s = max(s) OVER w AND min(s) OVER w < max(s) OVER w, false) AS best_similarity
FROM x WINDOW w AS (PARTITION BY comparison_id)""",
    "comparison_progress": """
SELECT comparison_id, count(*) FILTER (status IN ('done', 'failed')) AS finished, count(*) AS total, bool_and(status = 'done') AS complete, round(sum(duration_s), 3) AS seconds
FROM variants GROUP BY comparison_id""",
    "grid_variants": """
WITH c AS (SELECT id, CASE WHEN len(models) = 0 OR models IS NULL THEN [''] ELSE models END AS m, CASE WHEN len(lagen) = 0 OR lagen IS NULL THEN [''] ELSE lagen END AS l FROM comparisons),
d AS (SELECT id, list_filter(m, lambda x, i: list_position(m, x) = i) AS m, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM c),
a AS (SELECT id, m, l, unnest(m) AS model, generate_subscripts(m, 1) - 1 AS mi FROM d),
b AS (SELECT *, unnest(l) AS lage, generate_subscripts(l, 1) - 1 AS li FROM a),
g AS (SELECT * FROM (VALUES (0, 0.8, 16.0), (1, 0.8, 32.0), (2, 0.8, 64.0), (3, 1.0, 16.0), (4, 1.0, 32.0), (5, 1.0, 64.0), (6, 1.2, 16.0), (7, 1.2, 32.0), (8, 1.2, 64.0)) AS t(o, speed, nfe_step)),
x AS (SELECT b.*, g.*, (mi * len(l) + li) * 9 + o AS p FROM b, g)
SELECT id, CAST(p AS BIGINT) AS place, model, lage, CAST(speed AS DOUBLE) AS speed, CAST(nfe_step AS DOUBLE) AS nfe_step,
  CASE WHEN len(m) > 1 THEN coalesce(nullif(model, ''), 'Pretrain') || ', ' ELSE '' END || CASE WHEN len(l) > 1 THEN coalesce(nullif(lage, ''), 'neutral') || ', ' ELSE '' END
  || 'speed ' || CASE speed WHEN 1.0 THEN '1' ELSE CAST(speed AS VARCHAR) END || ' nfe_step ' || CAST(CAST(nfe_step AS INTEGER) AS VARCHAR) AS label
FROM x WHERE p < 12""",
    "grid_reconfigure": f"""
WITH c AS (SELECT id, CASE WHEN len(models) = 0 OR models IS NULL THEN [''] ELSE models END AS m, CASE WHEN len(lagen) = 0 OR lagen IS NULL THEN [''] ELSE lagen END AS l FROM comparisons),
a AS (SELECT id, unnest(list_distinct(m)) AS model, l FROM c), b AS (SELECT id, model, unnest(list_distinct(l)) AS lage FROM a),
n AS (SELECT DISTINCT id AS comparison_id, 'speed=' || s AS k, model, lage, 1 AS n FROM b, (VALUES ('800'), ('900'), ('1000'), ('1100')) AS t(s)),
o AS (SELECT DISTINCT comparison_id, {_KEY.format("grid_options")} AS k, coalesce(model, '') AS model, coalesce(lage, '') AS lage, 1 AS o FROM variants),
f AS (SELECT comparison_id, n, o FROM n FULL JOIN o USING (comparison_id, k, model, lage))
SELECT comparison_id, count(*) FILTER (n IS NOT NULL AND o IS NOT NULL) AS kept, count(*) FILTER (o IS NULL) AS new, count(*) FILTER (n IS NULL) AS removed FROM f GROUP BY comparison_id""",
    "lists_of_comparisons": """
WITH x AS (SELECT id, list_filter(lagen, lambda v: v <> '') AS r, models FROM comparisons),
y AS (SELECT id, list_filter(r, lambda v, i: list_position(r, v) = i) AS l, len(list_distinct(models)) AS models FROM x)
SELECT id, array_to_string(list_filter(l, lambda v: list_contains(['neutral', 'traurig', 'ernst'], v)), ',') AS known,
  array_to_string(list_concat(list_filter(l, lambda v: NOT list_contains(['neutral', 'traurig', 'ernst'], v)), list_filter(['neutral', 'traurig', 'ernst'], lambda v: NOT list_contains(l, v))), ',') AS toggled,
  array_to_string(list_concat(['neutral'], list_filter(l, lambda v: v <> 'neutral')), ',') AS listed, CAST(models AS INTEGER) AS models FROM y""",
    "catalog": """
SELECT id, name, coalesce(strftime(try_cast(regexp_replace(replace(created_at, 'T', ' '), '(Z|\\+00:00)$', '') AS TIMESTAMP), '%d.%m.%Y, %H:%M'), created_at) AS created FROM projects""",
    "newest_projects": """
SELECT id FROM projects ORDER BY try_cast(regexp_replace(replace(created_at, 'T', ' '), '(Z|\\+00:00)$', '') AS TIMESTAMP) DESC NULLS LAST, id LIMIT 5""",
    "project_slugs": """
WITH s AS (SELECT id, left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS s FROM projects) SELECT id, coalesce(nullif(s, ''), 'projekt') AS slug FROM s""",
    "unique_labels": """
WITH s AS (SELECT variant_id, comparison_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'variante') AS s FROM variants),
g AS (SELECT comparison_id, list(variant_id ORDER BY variant_id, s) AS v, list([s] ORDER BY variant_id, s) AS l FROM s GROUP BY comparison_id),
u AS (SELECT comparison_id, v, list_reduce(l, lambda a, x: list_append(a, CASE WHEN NOT list_contains(a, x[1]) THEN x[1] ELSE x[1] || '-' || list_filter(range(2, len(a) + 3), lambda n: NOT list_contains(a, x[1] || '-' || n))[1] END)) AS r FROM g)
SELECT unnest(v) AS variant_id, comparison_id, unnest(r) AS slug FROM u""",
    "sample_rates": "SELECT voice, count(DISTINCT sample_rate) AS rates, count(DISTINCT sample_rate) > 1 AS mixed, count(*) AS projects FROM projects GROUP BY voice",
    "lexicon_upsert": """
SELECT DISTINCT voice AS word, 'neu' AS spoken FROM projects WHERE voice IS NOT NULL
UNION ALL SELECT DISTINCT name, 'alt' FROM voices WHERE name NOT IN (SELECT voice FROM projects WHERE voice IS NOT NULL)""",
    "acronym_candidates": f"""
WITH names AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ0123456789', '')) AS k,
  unnest(string_split('A Be Ze De E Ef Ge Ha I Jot Ka El Em En O Pe Ku Er Es Te U Vau We Iks Ypsilon Zett Ä Ö Ü Null Eins Zwei Drei Vier Fünf Sechs Sieben Acht Neun', ' ')) AS v),
t AS (SELECT DISTINCT chunk_id, project_id, raw_text FROM chunks),
w AS (SELECT DISTINCT chunk_id, project_id, unnest(string_split_regex(raw_text, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM t),
a AS (SELECT word, count(*) AS n, min(project_id) AS first_source FROM w WHERE regexp_full_match(word, '[A-ZÄÖÜ][A-ZÄÖÜ0-9]+') AND length(regexp_replace(word, '[0-9]', '', 'g')) >= 2 GROUP BY word),
l AS (SELECT word, unnest(string_split(word, '')) AS k, generate_subscripts(string_split(word, ''), 1) AS i FROM a),
s AS (SELECT word, string_agg(v, '-' ORDER BY i) AS spelled FROM l JOIN names USING (k) GROUP BY word)
SELECT a.word, n, first_source, spelled FROM a JOIN s USING (word) WHERE lower(a.word) NOT IN ('mp3', 'e.l.k.', 'dr.', 'ka')""",
    "typography": """
SELECT DISTINCT teil_id, translate(regexp_replace(translate(text, chr(160) || chr(8239), '  '), ' [–—] ', ', ', 'g'), '„“”»«‚‘’…', '\"\"\"\"\"''''''.') AS text FROM teile""",
    "collapsed_space": f"""
WITH t AS (SELECT DISTINCT teil_id, text FROM teile),
u AS (SELECT teil_id, regexp_replace(regexp_replace(text, '\\bhttps?://[^\\s\\x0b]+', '', 'g'), '\\bwww\\.[^\\s\\x0b]+', '', 'g') AS x FROM t),
v AS (SELECT teil_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM u)
SELECT teil_id, {_strip("x")} AS text FROM v""",
    "comparison_forms": """
WITH t AS (SELECT DISTINCT chunk_id, normalized_text AS x FROM chunks)
SELECT chunk_id, trim(regexp_replace(replace(replace(replace(replace(lower(nfc_normalize(x)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS form FROM t""",
    "heading_lines": _TITLE,
    "joined_neighbours": f"""
WITH x AS (SELECT DISTINCT project_id, teil_no, chunk_index, chunk_id, raw_text FROM chunks),
y AS (SELECT a.chunk_id, {_strip("a.raw_text")} AS l, {_strip("b.raw_text")} AS r FROM x a JOIN x b ON b.project_id = a.project_id AND b.teil_no = a.teil_no AND b.chunk_index = a.chunk_index + 1),
z AS (SELECT *, rtrim(l, '"'')]»›“”') AS core FROM y)
SELECT chunk_id, CASE WHEN l = '' THEN r WHEN r = '' THEN l ELSE l || CASE WHEN core <> '' AND NOT contains('.!?…:,;', right(core, 1)) THEN '.' ELSE '' END || ' ' || r END AS text FROM z""",
    "rebuilt_texts": """
WITH x AS (SELECT project_id, teil_no, chunk_index, raw_text, bool_or(coalesce(ends_paragraph, false)) AS e FROM chunks WHERE raw_text IS NOT NULL GROUP BY ALL)
SELECT project_id, teil_no, rtrim(string_agg(raw_text || CASE WHEN e THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY chunk_index, raw_text), chr(10) || ' ') AS raw_text FROM x GROUP BY project_id, teil_no""",
    "number_words": f"SELECT n, {_cardinal('n')} AS word FROM (SELECT unnest(range(0, 1000000)) AS n)",
    "ordinal_words": f"""
SELECT n, CASE WHEN n = 100 THEN 'hundertste' ELSE ({_thousand("(n - n % 100)", "")}) || CASE n % 100 WHEN 1 THEN 'erste' WHEN 3 THEN 'dritte' WHEN 7 THEN 'siebte' WHEN 8 THEN 'achte'
  ELSE ({_hundred("(n % 100)", "")}) || CASE WHEN n % 100 > 0 AND n % 100 < 20 THEN 'te' ELSE 'ste' END END END AS word FROM (SELECT unnest(range(1, 1000)) AS n)""",
    "year_words": f"""
SELECT n, CASE WHEN n BETWEEN 1100 AND 1999 THEN ({_cardinal("(n // 100)")}) || 'hundert' || CASE WHEN n % 100 > 0 THEN ({_cardinal("(n % 100)")}) ELSE '' END ELSE ({_cardinal("n")}) END AS word
FROM (SELECT unnest(range(1000, 2200)) AS n)""",
    "chunk_seeds": f"""
WITH {_current("project_id", "chunk_index", "attempts")}
SELECT chunk_id, CAST(('0x' || substr(sha1(project_id || ':' || chunk_index || ':' || attempts), 1, 8)) AS BIGINT) % 2147483647 AS seed FROM cur""",
    "pause_timeline": """
WITH x AS (SELECT project_id, chunk_index, length(normalized_text) AS n, bool_or(coalesce(is_heading, false)) AS h, bool_or(coalesce(ends_paragraph, false)) AS e FROM chunks GROUP BY 1, 2, 3),
y AS (SELECT project_id, chunk_index, round(n / 14.0::DOUBLE, 3) AS seconds, CASE WHEN chunk_index = max(chunk_index) OVER (PARTITION BY project_id) THEN 0.0 WHEN h THEN 1.2 WHEN e THEN 0.8 ELSE 0.35 END AS pause_s FROM x)
SELECT project_id, chunk_index, seconds, CAST(pause_s AS DOUBLE) AS pause_s,
  round(coalesce(sum(CAST(round((coalesce(seconds, 0) + pause_s) * 1000) AS BIGINT)) OVER (PARTITION BY project_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000.0::DOUBLE, 3) AS start_s FROM y""",
    "reject_reasons": f"WITH {_REASON} SELECT * FROM r",
    "reject_report": f"WITH {_REASON} SELECT split_part(reason, ' -- ', 1) AS kind, count(*) AS n, min(chunk_id) AS \"first\", max(chunk_id) AS \"last\" FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "voice_checks": f"""
WITH v AS (SELECT *, nullif(length({_strip("coalesce(transcript, '')")}), 0) / nullif(duration_s, 0) AS r FROM voices)
SELECT name, lage, concat_ws(',', CASE WHEN duration_s < 5 THEN 'kurz' END, CASE WHEN duration_s > 12 THEN 'lang' END, CASE WHEN sample_rate < 16000 THEN 'rate' END, CASE WHEN r < 7 THEN 'wenig' END, CASE WHEN r > 24 THEN 'viel' END) AS warnings,
  duration_s >= 1 AS ok,
  CASE WHEN chars_per_second > 0 AND NOT (14.5 / chars_per_second BETWEEN 0.95 AND 1.05) THEN round(greatest(0.5, least(1.5, 14.5 / chars_per_second)), 2) END AS speed,
  round(greatest(4.0, least(20.0, 22.0 - least(coalesce(duration_s, 0), 12.0))), 3) AS budget FROM v""",
    "training_plans": """
WITH s AS (SELECT model, round(sum(duration_s), 2) AS seconds FROM variants GROUP BY model),
p AS (SELECT *, 1600 / 93.75::DOUBLE AS step_seconds, greatest(1, CAST(round_even(seconds / (1600 / 93.75::DOUBLE), 0) AS BIGINT)) AS steps_per_epoch, CAST(round_even(seconds, 0) AS BIGINT) AS t FROM s),
q AS (SELECT *, steps_per_epoch * 100 AS total_steps FROM p),
r AS (SELECT *, greatest(10, least(200, total_steps // 10)) AS warmup_steps, greatest(50, least(1000, total_steps // 5)) AS save_every FROM q)
SELECT model, seconds, step_seconds, steps_per_epoch, total_steps, warmup_steps, save_every, greatest(25, least(500, save_every // 2)) AS last_every,
  CASE WHEN t < 60 THEN t || ' s' WHEN t < 3600 THEN t // 60 || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || ' min'
  ELSE t // 3600 || ':' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || ' h' END AS duration FROM r""",
    "voice_similarity": """
WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label)
SELECT vec_id, round(CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(ref, lambda x: x::DOUBLE * x)) > 0
  THEN list_inner_product(embedding::DOUBLE[], ref::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(ref::DOUBLE[], ref::DOUBLE[]))) ELSE 0 END, 6) AS similarity
FROM embeddings JOIN r USING (label)""",
    "speech_islands": f"""
WITH {_islands("value > 80", 3)}
SELECT *, least("start" - lag("end") OVER w, lead("start") OVER w - "end") AS gap FROM r WINDOW w AS (PARTITION BY user_id ORDER BY "start")""",
    "inner_pauses": f"""
WITH {_islands("value < 50", 1)}, e AS (SELECT user_id, min(frame) AS a, max(frame) + 1 AS b FROM f GROUP BY user_id)
SELECT user_id, CAST(coalesce(sum(CASE WHEN "end" - "start" >= 3 AND "start" > a AND "end" < b THEN 1 ELSE 0 END), 0) AS BIGINT) AS pauses, coalesce(max("end" - "start"), 0) AS longest FROM e LEFT JOIN r USING (user_id) GROUP BY user_id""",
    "threshold_sweep": """
SELECT user_id, CAST(t AS INTEGER) AS threshold, count(*) FILTER (value < t) AS quiet, count(*) AS frames FROM events, (SELECT unnest(range(10, 101, 10)) AS t) GROUP BY 1, 2""",
    "level_background": f"""
WITH {_FRAMES}, m AS (SELECT user_id, value, quantile_cont(value, 0.5) OVER w AS m, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS 19 PRECEDING))
SELECT user_id, round(coalesce(min(m) FILTER (n = 20), min(value)), 6) AS floor, round(quantile_cont(value, 0.95), 6) AS speech FROM m GROUP BY user_id""",
    "level_thresholds": """
WITH d AS (SELECT user_id, 20 * log10(greatest(value / 500, 1e-12)) AS db FROM events), x AS (SELECT user_id, min(db) AS f, quantile_cont(db, 0.95) AS s FROM d GROUP BY user_id)
SELECT user_id, round(least(greatest(f + 10, s - 25, -55), -20), 6) AS threshold FROM x""",
    "merged_headings": f"""
WITH x AS (SELECT project_id, chunk_index, raw_text, bool_or(coalesce(is_heading, false)) AS h, bool_or(coalesce(ends_paragraph, false)) AS e FROM chunks GROUP BY 1, 2, 3),
m AS (SELECT a.project_id, a.chunk_index FROM x a LEFT JOIN x b ON b.project_id = a.project_id AND b.chunk_index = a.chunk_index - 1 AND b.h WHERE a.h AND b.h IS NULL),
p AS (SELECT m.*, n.raw_text AS r, n.h AS nh, n.e AS ne FROM m JOIN x n ON n.project_id = m.project_id AND n.chunk_index = m.chunk_index + 1),
y AS (SELECT x.*, p.r, p.nh, p.ne, {_strip("x.raw_text")} AS a, {_strip("p.r")} AS b FROM x LEFT JOIN p USING (project_id, chunk_index)
  WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.project_id = x.project_id AND q.chunk_index + 1 = x.chunk_index)),
z AS (SELECT *, rtrim(a, '"'')]»›“”') AS core FROM y)
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY chunk_index) - 1 AS INTEGER) AS chunk_index,
  CASE WHEN r IS NULL THEN raw_text WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || CASE WHEN core <> '' AND NOT contains('.!?…:,;', right(core, 1)) THEN '.' ELSE '' END || ' ' || b END AS raw_text,
  CASE WHEN r IS NULL THEN h ELSE h AND nh END AS is_heading, CASE WHEN r IS NULL THEN e ELSE ne END AS ends_paragraph FROM z""",
    "utterance_figures": f"""
WITH {_REASON}, c2 AS (SELECT chunk_id, engine FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(saved_at, TIMESTAMP '0001-01-01') DESC, engine DESC NULLS LAST) AS _r FROM chunks) WHERE _r = 1),
x AS (SELECT coalesce(engine, '-') AS engine, reason, length(normalized_text) / 14.0::DOUBLE AS s, length(asr_text) AS n FROM r JOIN cur USING (chunk_id) JOIN c2 USING (chunk_id))
SELECT engine, count(*) FILTER (reason IS NULL) AS segments, coalesce(round(sum(s) FILTER (reason IS NULL) / 60, 6), 0) AS minutes, coalesce(round(median(s) FILTER (reason IS NULL), 6), 0) AS median_s,
  coalesce(round(median(CASE WHEN s > 0 THEN n / s ELSE 0 END) FILTER (reason IS NULL), 6), 0) AS median_pace, count(*) FILTER (reason IS NOT NULL) AS rejected,
  coalesce(round(sum(s) FILTER (reason IS NOT NULL) / 60, 6), 0) AS rejected_minutes FROM x GROUP BY engine""",
    "short_text_durations": """
WITH v AS (SELECT name AS voice, transcript, duration_s FROM voices WHERE lage = 'neutral'), p AS (SELECT id AS project_id, transcript, duration_s FROM projects JOIN v USING (voice)),
x AS (SELECT DISTINCT chunk_id, project_id, normalized_text FROM chunks)
SELECT chunk_id, round(duration_s + length(normalized_text) / 14.0::DOUBLE + 0.5, 3) AS seconds FROM x JOIN p USING (project_id)
WHERE length(normalized_text) <= 80 AND duration_s > 0 AND duration_s / nullif(strlen(transcript), 0) * strlen(normalized_text) < length(normalized_text) / 14.0::DOUBLE + 0.5""",
    "text_flags": rf"""
WITH x AS (SELECT DISTINCT chunk_id, project_id, raw_text, normalized_text FROM chunks),
y AS (SELECT project_id, length(normalized_text) > 280 AS o, rtrim(regexp_extract({_strip("raw_text")}, '^([^ \t\n\x0b\f\r]+)', 1), '"'')]»›“”') AS w,
  split_part(trim(regexp_replace(replace(replace(replace(replace(lower(normalized_text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ', 1) AS f FROM x)
SELECT project_id, count(*) FILTER (o) AS over, count(*) FILTER (w <> '' AND contains(',;:.!?…–—-', right(w, 1))) AS pauses, count(DISTINCT f) AS first_words FROM y GROUP BY project_id""",
    "project_ids": """
WITH s AS (SELECT id, try_cast(regexp_replace(replace(created_at, 'T', ' '), '(Z|\\+00:00)$', '') AS TIMESTAMP) AS made_at, left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS s FROM projects)
SELECT id, strftime(made_at, '%Y%m%d-%H%M%S') || '-' || coalesce(nullif(s, ''), 'projekt') AS made FROM s""",
}

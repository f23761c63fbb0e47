"""Queries over states, runs and changed texts, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lesewerk.functions import columns as c
from lesewerk.functions import files
from lesewerk.operators import curation, ordered, states, tables
from lesewerk.plans.oracle import _current, _strip
from lesewerk.sources.tables import table

#: Characters of a chunk that an engine still takes in one piece.
MOST_CHARS = 350


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return tables.current(table(spark, d, "chunks").select("chunk_id", *columns, "saved_at"))


def _said(text: Column) -> Column:
    """A spoken form that plain expressions make: typography and white space."""
    return c.collapse_space(c.clean_typography(text))


_SQL_SAID = """regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(translate({0}, chr(160) || chr(8239), '  '), ' [–—] ', ', ', 'g'), '„“”»«‚‘’…', '\"\"\"\"\"''''''.'),
 '[ \\t]+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"""


def _sql_said(x: str) -> str:
    return _strip(_SQL_SAID.format(x))


def _sql_seed(attempts: str) -> str:
    return f"CAST(('0x' || substr(sha1(project_id || ':' || chunk_index || ':' || ({attempts})), 1, 8)) AS BIGINT) % 2147483647"


def _length_score(spoken: Column, heard: Column) -> Column:
    """A score that needs no edit distance: how much shorter or longer the transcription is."""
    return F.abs(F.length(spoken) - F.length(heard)) / F.greatest(F.length(spoken), F.lit(1))


def work_lists(spark: SparkSession, d: str) -> DataFrame:
    x = _chunks(spark, d, "status")
    lists = {"synthesis": states.pending_synthesis(x), "check": states.pending_check(x), "review": states.flagged(x)}
    out = [rows.select("chunk_id", F.lit(kind).alias("kind")) for kind, rows in lists.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def checked_states(spark: SparkSession, d: str) -> DataFrame:
    """All transcribed chunks judged anew."""
    x = _chunks(spark, d, "status", "normalized_text", "asr_text", "cer").where("asr_text is not null").withColumn("status", F.lit(states.SYNTHESIZED))
    return states.checked(x, F.col("asr_text"), _length_score).select("chunk_id", "status", "cer")


def rerolled_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = _chunks(spark, d, "project_id", "chunk_index", "status", "seed", "attempts", "cer")
    return states.reroll(x, states.is_state(*states.FLAGGED)).select("chunk_id", "status", "seed", "attempts", F.nanvl("cer", F.lit(None)).alias("cer"))


def discarded_sound(spark: SparkSession, d: str) -> DataFrame:
    x = _chunks(spark, d, "status", "seed", "audio_file")
    return states.discard_sound(x, states.is_state(*states.FLAGGED)).select("chunk_id", "status", "seed", "audio_file")


def retexted_headings(spark: SparkSession, d: str) -> DataFrame:
    x = _chunks(spark, d, "project_id", "chunk_index", "status", "is_heading", "raw_text", "normalized_text", "attempts")
    texts = x.where("is_heading").select("project_id", "chunk_index", F.concat("raw_text", F.lit(" – neu")).alias("raw_text"))
    return states.retext(x, texts, _said).select("chunk_id", "raw_text", "normalized_text", "status", "attempts")


def refreshed_forms(spark: SparkSession, d: str) -> DataFrame:
    x = _chunks(spark, d, "project_id", "chunk_index", "status", "raw_text", "normalized_text", "seed", "attempts")
    return states.refresh_spoken(x, _said(F.col("raw_text"))).select("chunk_id", "normalized_text", "status", "seed")


def mood_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every heading in a serious mood."""
    x = _chunks(spark, d, "project_id", "chunk_index", "status", "is_heading", "lage", "audio_file")
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), "lage")
    wanted = x.where("is_heading").select("project_id", "chunk_index", F.lit(" ernst ").alias("lage"))
    return states.set_lage(x, p, wanted).select("chunk_id", "lage", "changed", "status")


def default_mood_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every project with 'neutral' as its written default."""
    x = _chunks(spark, d, "project_id", "chunk_index", "status", "lage", "audio_file")
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), "lage")
    out = states.set_default_lage(x, p, p.select("project_id", F.lit("neutral").alias("lage")))
    return out.groupBy("project_id").agg(F.count_if("changed").alias("changed"), F.count_if(F.col("status") == "pending").alias("pending"))


def rendering_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A run of three rounds; what is heard is cut short for seeds that a stand-in engine says badly."""
    x = _chunks(spark, d, "project_id", "chunk_index", "status", "normalized_text", "seed", "attempts")
    text = F.col("normalized_text")
    heard = F.when(F.col("seed") % 3 == 0, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(text)
    out = states.run_rounds(x, F.concat(F.lit("chunk_"), F.col("chunk_index"), F.lit(".wav")), F.when(F.length(c.strip_space(text)) < 8, "zu kurz"), heard, _length_score, "stub")
    return out.select("chunk_id", "status", "attempts", "seed", "cer", "audio_file", "error")


def _round_sql(k: int, last: bool) -> str:
    """Round k of a run over r{k}, as CTEs that end in r{k + 1}."""
    todo, new = "g AND status IN ('pending', 'failed')", f"r{k + 1}"
    made = f"""a{k} AS (SELECT * REPLACE (g AND bool_or(coalesce({todo}, false)) OVER (PARTITION BY project_id) AS g) FROM r{k}),
b{k} AS (SELECT *, CASE WHEN {todo} THEN CASE WHEN short THEN 'failed' ELSE 'synthesized' END ELSE status END AS s,
  CASE WHEN {todo} AND NOT short THEN 'chunk_' || chunk_index || '.wav' ELSE audio_file END AS f, CASE WHEN {todo} THEN CASE WHEN short THEN 'zu kurz' END ELSE error END AS e FROM a{k}),
c{k} AS (SELECT *, CASE WHEN g AND s = 'synthesized' THEN CASE WHEN seed % 3 = 0 THEN n - n // 2 ELSE 0 END / greatest(n, 1)::DOUBLE END AS score FROM b{k}),
d{k} AS (SELECT chunk_id, project_id, chunk_index, n, short, seed, attempts, g, f AS audio_file, e AS error,
  CASE WHEN g AND s = 'synthesized' THEN CASE WHEN coalesce(score <= 0.1, true) THEN 'ok' ELSE 'needs_review' END ELSE s END AS status, CASE WHEN g AND s = 'synthesized' THEN round(score, 4) ELSE cer END AS cer FROM c{k})"""
    if last:
        return f"{made}, {new} AS (SELECT * FROM d{k})"
    again = "g AND status = 'needs_review'"
    return f"""{made}, e{k} AS (SELECT * REPLACE (g AND bool_or(coalesce(status = 'needs_review', false)) OVER (PARTITION BY project_id) AS g) FROM d{k}),
{new} AS (SELECT chunk_id, project_id, chunk_index, n, short, CASE WHEN {again} THEN {_sql_seed("coalesce(attempts, 0) + 1")} ELSE seed END AS seed,
  CASE WHEN {again} THEN coalesce(attempts, 0) + 1 ELSE attempts END AS attempts, g, audio_file, CASE WHEN {again} THEN NULL ELSE error END AS error,
  CASE WHEN {again} THEN 'pending' ELSE status END AS status, CASE WHEN {again} THEN NULL ELSE cer END AS cer FROM e{k})"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "teile").select("project_id", "teil_no", "text", "handschnitt")
    return old, old.withColumn("text", F.regexp_replace("text", r"[ \t]+", " "))


def part_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Which parts keep their cut if stray spaces are taken out of the texts."""
    old, new = _parts(spark, d)
    return states.kept_cuts(old, new, _chunks(spark, d, "project_id", "teil_no", "normalized_text"), MOST_CHARS)


def reconfigured_projects(spark: SparkSession, d: str) -> DataFrame:
    """The same, with every other part cut anew into chunks whose spoken form is freed of stray signs."""
    old, new = _parts(spark, d)
    x = _chunks(spark, d, "project_id", "teil_no", "chunk_index", "raw_text", "normalized_text", "ends_paragraph", "is_heading", "audio_file", "status", "seed", "attempts", "lage")
    fresh = x.select("project_id", "teil_no", "chunk_index", "raw_text", _said(F.col("normalized_text")).alias("normalized_text"), "ends_paragraph", "is_heading")
    after = states.reconfigure(x, fresh, states.kept_cuts(old, new, x, MOST_CHARS))
    return states.reconfigure_report(x, after)


def recorded_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each variant with the medians and the length of its project's chunks."""
    x = _chunks(spark, d, "project_id", "status", "cer", "speaker_similarity", "audio_file", "normalized_text")
    seconds = x.where("audio_file is not null").groupBy("project_id").agg(F.round(F.sum(F.length("normalized_text")) / 14.0, 3).alias("seconds"))
    p = tables.progress(x, ["project_id"]).select("project_id", "median_cer", "median_similarity").join(seconds, "project_id", "left")
    v = table(spark, d, "variants").select("variant_id", "project_id")
    return curation.recorded(v, p, "project_id")


def longest_references(spark: SparkSession, d: str) -> DataFrame:
    """The longest recording of each project's voice, 0 for unknown voices."""
    return curation.longest_reference(table(spark, d, "projects").select("id", "voice"), table(spark, d, "voices"))


def first_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first three flagged chunks of each project and how many more there are: a report of so many rows."""
    x = states.flagged(_chunks(spark, d, "project_id", "chunk_index", "status")).select("project_id", "chunk_index", "chunk_id")
    return curation.first_rows(x, ["project_id"], ["chunk_index", "chunk_id"], 3)


def track_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The track of the chunks that have a sound: missing ones are passed over, not padded."""
    x = _chunks(spark, d, "project_id", "chunk_index", "normalized_text", "is_heading", "ends_paragraph", "audio_file").where("audio_file is not null and audio_file != ''")
    x = x.withColumn("seconds", F.round(F.length("normalized_text") / 14.0, 3))
    t = ordered.timeline(x, ["project_id"], "chunk_index", "seconds", "is_heading", "ends_paragraph")
    return t.groupBy("project_id").agg(F.count("*").alias("chunks"), F.round(F.sum(F.col("seconds") + F.col("pause_s")), 3).alias("seconds"))


def text_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Kind and media type of every sound file, and where a server would find it."""
    x = _chunks(spark, d, "project_id", "audio_file").where("audio_file is not null")
    path = F.concat(F.lit("D:\\sound\\"), "project_id", F.lit("\\"), "audio_file")
    return x.select("chunk_id", files.audio_suffix("audio_file").alias("suffix"), files.media_type("audio_file").alias("media_type"), files.server_path(path).alias("path"))


def wrapped_options(spark: SparkSession, d: str) -> DataFrame:
    """Options under the keys of a wrapper, with what the wrapper adds."""
    v = table(spark, d, "variants").select("variant_id", "grid_options")
    return v.select("variant_id", files.needs_wrapper(F.map_keys("grid_options"), "ema_model.").alias("needed"), F.explode(files.wrap_keys("grid_options", "ema_model.", {"initted": 1.0, "step": 0.0})).alias("key", "value"))


def missing_files(spark: SparkSession, d: str) -> DataFrame:
    """What a voice's recordings lack of the wanted moods."""
    v = table(spark, d, "voices").groupBy("name").agg(F.collect_set("lage").alias("there"))
    return v.select("name", F.array_join(files.missing(["neutral", "ernst", "heiter", "traurig"], "there"), ",").alias("missing"))


def lexicon_changes(spark: SparkSession, d: str) -> DataFrame:
    """Voices as a lexicon: those with a neutral recording of 8 s and more under another name, those below 6 s taken out."""
    v = table(spark, d, "voices").where("lage = 'neutral'").select(F.col("name").alias("word"), "duration_s")
    names = v.where("duration_s >= 8").select(F.col("word").alias("old_name"), F.concat("word", F.lit(" (neu)")).alias("new_name"))
    out = tables.renamed(v.select("word", F.round("duration_s", 3).alias("spoken")), names, "word")
    return tables.removed(out, v.where("duration_s < 6").select("word"), "word")


def chunk_limit_report(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk of each project may last beside its voice's neutral recording, and at most."""
    v = table(spark, d, "voices").where("lage = 'neutral'").groupBy(F.col("name").alias("voice")).agg(F.max("duration_s").alias("reference"))
    p = table(spark, d, "projects").select("id", "voice", F.coalesce("target_chunk_seconds", F.lit(20.0)).alias("target")).join(v, "voice", "left")
    limits = c.chunk_limits("target", F.lit(25.0), F.lit(22.0), "reference")
    return p.select("id", F.round(limits["budget"], 6).alias("budget"), F.round(limits["most"], 6).alias("most"))


QUERIES = {
    f.__name__: f
    for f in (
        work_lists, checked_states, rerolled_chunks, discarded_sound, retexted_headings, refreshed_forms, mood_changes, default_mood_changes, rendering_rounds, part_cuts,
        reconfigured_projects, recorded_variants, longest_references, first_findings, track_lengths, text_suffixes, wrapped_options, missing_files, lexicon_changes, chunk_limit_report,
    )
}

_FLAGGED = "coalesce(status IN ('needs_review', 'failed'), false)"
_CUTS = f"""
o AS (SELECT project_id, teil_no, max(text) AS t, bool_or(coalesce(handschnitt, false)) AS h FROM teile GROUP BY 1, 2),
w AS (SELECT project_id, teil_no, max(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS t FROM teile GROUP BY 1, 2),
l AS (SELECT project_id, teil_no, max(coalesce(length(normalized_text), 0)) AS n FROM cur GROUP BY 1, 2),
k AS (SELECT w.project_id, w.teil_no, coalesce(o.h AND w.t IS NOT DISTINCT FROM o.t AND l.n <= {MOST_CHARS}, false) AS kept FROM w LEFT JOIN o USING (project_id, teil_no) LEFT JOIN l USING (project_id, teil_no))"""

SQL = {
    "work_lists": f"""
WITH {_current("status")} SELECT chunk_id, 'synthesis' AS kind FROM cur WHERE status IN ('pending', 'failed') UNION ALL SELECT chunk_id, 'check' FROM cur WHERE status = 'synthesized'
UNION ALL SELECT chunk_id, 'review' FROM cur WHERE {_FLAGGED}""",
    "checked_states": f"""
WITH {_current("status", "normalized_text", "asr_text", "cer")}, s AS (SELECT chunk_id, abs(length(normalized_text) - length(asr_text)) / greatest(length(normalized_text), 1)::DOUBLE AS x FROM cur WHERE asr_text IS NOT NULL)
SELECT chunk_id, CASE WHEN coalesce(x <= 0.1, true) THEN 'ok' ELSE 'needs_review' END AS status, round(x, 4) AS cer FROM s""",
    "rerolled_chunks": f"""
WITH {_current("project_id", "chunk_index", "status", "seed", "attempts", "cer")}
SELECT chunk_id, CASE WHEN {_FLAGGED} THEN 'pending' ELSE status END AS status, CASE WHEN {_FLAGGED} THEN {_sql_seed("coalesce(attempts, 0) + 1")} ELSE seed END AS seed,
  CASE WHEN {_FLAGGED} THEN coalesce(attempts, 0) + 1 ELSE attempts END AS attempts, CASE WHEN {_FLAGGED} OR isnan(cer) THEN NULL ELSE cer END AS cer FROM cur""",
    "discarded_sound": f"""
WITH {_current("status", "seed", "audio_file")}
SELECT chunk_id, CASE WHEN {_FLAGGED} THEN 'pending' ELSE status END AS status, seed, CASE WHEN {_FLAGGED} THEN NULL ELSE audio_file END AS audio_file FROM cur""",
    "retexted_headings": f"""
WITH {_current("project_id", "chunk_index", "status", "is_heading", "raw_text", "normalized_text", "attempts")}, n AS (SELECT *, is_heading AND raw_text IS NOT NULL AS h, raw_text || ' – neu' AS r FROM cur)
SELECT chunk_id, CASE WHEN h THEN r ELSE raw_text END AS raw_text, CASE WHEN h THEN {_sql_said("r")} ELSE normalized_text END AS normalized_text, CASE WHEN h THEN 'pending' ELSE status END AS status,
  CASE WHEN h THEN coalesce(attempts, 0) + 1 ELSE attempts END AS attempts FROM n""",
    "refreshed_forms": f"""
WITH {_current("project_id", "chunk_index", "status", "raw_text", "normalized_text", "seed", "attempts")}, n AS (SELECT *, {_sql_said("raw_text")} AS r FROM cur), m AS (SELECT *, r IS DISTINCT FROM normalized_text AS h FROM n)
SELECT chunk_id, r AS normalized_text, CASE WHEN h THEN 'pending' ELSE status END AS status, CASE WHEN h THEN {_sql_seed("coalesce(attempts, 0) + 1")} ELSE seed END AS seed FROM m""",
    "mood_changes": f"""
WITH {_current("project_id", "chunk_index", "status", "is_heading", "lage", "audio_file")}, p AS (SELECT id AS project_id, max(lage) AS pl FROM projects GROUP BY 1),
x AS (SELECT cur.*, coalesce(is_heading AND 'ernst' <> coalesce(nullif(lage, ''), nullif(pl, ''), 'neutral'), false) AS changed FROM cur LEFT JOIN p USING (project_id))
SELECT chunk_id, CASE WHEN is_heading THEN 'ernst' ELSE lage END AS lage, changed, CASE WHEN changed THEN 'pending' ELSE status END AS status FROM x""",
    "default_mood_changes": f"""
WITH {_current("project_id", "chunk_index", "status", "lage", "audio_file")}, p AS (SELECT id AS project_id, max(coalesce(lage, '')) AS pl FROM projects GROUP BY 1),
x AS (SELECT cur.*, coalesce(pl <> 'neutral', false) AND coalesce(lage, '') = '' AND coalesce(audio_file, '') <> '' AS changed FROM cur LEFT JOIN p USING (project_id))
SELECT project_id, count(*) FILTER (changed) AS changed, count(*) FILTER (changed OR status = 'pending') AS pending FROM x GROUP BY 1""",
    "rendering_rounds": f"""
WITH {_current("project_id", "chunk_index", "status", "normalized_text", "seed", "attempts")},
r0 AS (SELECT chunk_id, project_id, chunk_index, length(normalized_text) AS n, coalesce(length({_strip("normalized_text")}) < 8, false) AS short, seed, attempts, true AS g, CAST(NULL AS VARCHAR) AS audio_file,
  CAST(NULL AS VARCHAR) AS error, status, CAST(NULL AS DOUBLE) AS cer FROM cur),
{_round_sql(0, False)}, {_round_sql(1, False)}, {_round_sql(2, True)}
SELECT chunk_id, status, attempts, seed, cer, audio_file, error FROM r3""",
    "part_cuts": f"WITH {_current('project_id', 'teil_no', 'normalized_text')}, {_CUTS} SELECT * FROM k",
    "reconfigured_projects": f"""
WITH {_current("project_id", "teil_no", "chunk_index", "raw_text", "normalized_text", "ends_paragraph", "is_heading", "audio_file", "status", "seed", "attempts", "lage")}, {_CUTS},
x AS (SELECT cur.*, {_sql_said("normalized_text")} AS said, coalesce(audio_file, '') <> '' AS sounds, coalesce(k.kept, false) AS stays, k.kept IS NOT NULL AS known FROM cur LEFT JOIN k USING (project_id, teil_no)),
f AS (SELECT project_id, said AS t, row_number() OVER (PARTITION BY project_id, said ORDER BY chunk_index) AS i FROM x WHERE known AND NOT stays AND said IS NOT NULL),
g AS (SELECT project_id, normalized_text AS t, row_number() OVER (PARTITION BY project_id, normalized_text ORDER BY chunk_index) AS i FROM x WHERE NOT stays AND sounds AND normalized_text IS NOT NULL),
m AS (SELECT project_id, count(g.t) AS matched, count(*) AS fresh FROM f LEFT JOIN (SELECT project_id, t, i FROM g) g USING (project_id, t, i) GROUP BY project_id),
s AS (SELECT project_id, count(*) AS old, count(*) FILTER (stays) AS stayed, count(*) FILTER (stays AND sounds) AS sounding FROM x GROUP BY project_id)
SELECT project_id, sounding + coalesce(matched, 0) AS kept, coalesce(fresh - matched, 0) AS new, old - stayed - coalesce(matched, 0) AS removed FROM s LEFT JOIN m USING (project_id)""",
    "recorded_variants": f"""
WITH {_current("project_id", "status", "cer", "speaker_similarity", "audio_file", "normalized_text")},
p AS (SELECT project_id, round(median(CASE WHEN NOT isnan(cer) AND cer >= 0 THEN cer END), 6) AS median_cer,
  round(median(CASE WHEN NOT isnan(speaker_similarity) THEN CASE WHEN speaker_similarity > 1 THEN speaker_similarity / 100 ELSE speaker_similarity END END), 6) AS median_similarity,
  round(sum(length(normalized_text)) FILTER (audio_file IS NOT NULL) / 14.0::DOUBLE, 3) AS seconds FROM cur GROUP BY 1)
SELECT variant_id, p.median_cer, p.median_similarity, seconds FROM variants LEFT JOIN p USING (project_id)""",
    "longest_references": "SELECT id, coalesce(max(duration_s), 0) AS seconds FROM projects LEFT JOIN voices ON voices.name = projects.voice GROUP BY id",
    "first_findings": f"""
WITH {_current("project_id", "chunk_index", "status")}, f AS (SELECT project_id, chunk_index, chunk_id, row_number() OVER (PARTITION BY project_id ORDER BY chunk_index, chunk_id) AS r, count(*) OVER (PARTITION BY project_id) AS n FROM cur WHERE {_FLAGGED})
SELECT project_id, chunk_index, chunk_id, greatest(n - 3, 0) AS more FROM f WHERE r <= 3""",
    "track_lengths": f"""
WITH {_current("project_id", "chunk_index", "normalized_text", "is_heading", "ends_paragraph", "audio_file")},
x AS (SELECT project_id, round(length(normalized_text) / 14.0::DOUBLE, 3) AS s, CASE WHEN chunk_index = max(chunk_index) OVER (PARTITION BY project_id) THEN 0.0 WHEN is_heading THEN 1.2 WHEN ends_paragraph THEN 0.8 ELSE 0.35 END AS p FROM cur WHERE audio_file <> '')
SELECT project_id, count(*) AS chunks, round(sum(s + p), 3) AS seconds FROM x GROUP BY 1""",
    "text_suffixes": f"""
WITH {_current("project_id", "audio_file")}, s AS (SELECT chunk_id, project_id, audio_file, regexp_extract(lower(audio_file), '[.]([a-z0-9]+)$', 1) AS e FROM cur WHERE audio_file IS NOT NULL)
SELECT chunk_id, CASE WHEN e IN ('wav', 'flac', 'ogg', 'mp3', 'm4a') THEN '.' || e ELSE '.wav' END AS suffix,
  CASE e WHEN 'flac' THEN 'audio/flac' WHEN 'ogg' THEN 'audio/ogg' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'm4a' THEN 'audio/mp4' WHEN 'wav' THEN 'audio/wav' ELSE 'application/octet-stream' END AS media_type,
  '/mnt/d/sound/' || project_id || '/' || audio_file AS path FROM s""",
    "wrapped_options": """
WITH k AS (SELECT variant_id, len(list_filter(map_keys(grid_options), lambda x: starts_with(x, 'ema_model.'))) = 0 AS needed, grid_options AS o FROM variants WHERE grid_options IS NOT NULL),
e AS (SELECT variant_id, needed, unnest(map_keys(o)) AS key, unnest(map_values(o)) AS value FROM k)
SELECT variant_id, needed, 'ema_model.' || key AS key, value FROM e UNION ALL SELECT variant_id, needed, 'initted', 1.0 FROM k UNION ALL SELECT variant_id, needed, 'step', 0.0 FROM k""",
    "lexicon_changes": """
WITH v AS (SELECT name AS word, round(duration_s, 3) AS spoken, duration_s FROM voices WHERE lage = 'neutral')
SELECT CASE WHEN duration_s >= 8 THEN word || ' (neu)' ELSE word END AS word, spoken FROM v WHERE duration_s >= 6 OR duration_s IS NULL""",
    "chunk_limit_report": """
WITH v AS (SELECT name AS voice, max(duration_s) AS r FROM voices WHERE lage = 'neutral' GROUP BY 1), p AS (SELECT id, coalesce(target_chunk_seconds, 20) AS t, r FROM projects LEFT JOIN v USING (voice)),
b AS (SELECT *, greatest(4.0, least(t, 22.0 - least(coalesce(r, 0), 12.0))) AS budget FROM p)
SELECT id, round(budget, 6) AS budget, round(CASE WHEN budget < t THEN budget ELSE 25.0 END, 6) AS most FROM b""",
    "missing_files": """
SELECT name, array_to_string(list_filter(['neutral', 'ernst', 'heiter', 'traurig'], lambda x: NOT list_contains(list(lage), x)), ',') AS missing FROM voices GROUP BY name""",
}

"""The library's own operators as queries on the test tables. Every query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lesewerk.functions import columns as c
from lesewerk.functions import german, metrics
from lesewerk.operators import curation, editing, ordered, recordings, segment, signal, tables
from lesewerk.sources.tables import table

#: Option limits of an engine: lowest, highest, whole numbers only.
OPTIONS = {"speed": (0.5, 1.5, False), "nfe_step": (8.0, 64.0, True), "cfg_strength": (0.5, 4.0, False)}
GRID = {"speed": [0.8, 1.0, 1.0, 1.2], "nfe_step": [16.0, 32.0, 99.0]}
LEXICON = {"MP3": "Em-Pe-3", "E.L.K.": "E-El-Ka", "Dr.": "Doktor"}
RATE = 14.0


def _current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return tables.current(table(spark, d, "chunks").select("chunk_id", *[x for x in columns if x != "saved_at"], "saved_at"))


# ---- relational


def project_progress(spark: SparkSession, d: str) -> DataFrame:
    return tables.progress(_current(spark, d, "project_id", "status", "cer", "speaker_similarity"), ["project_id"])


def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    p = tables.progress(_current(spark, d, "project_id", "status", "cer", "speaker_similarity"), ["project_id"])
    every = table(spark, d, "projects").select(F.col("id").alias("project_id")).distinct().join(p, "project_id", "left")
    return every.agg(
        F.count("*").alias("projects"), F.count_if("complete").alias("complete"), (F.count("*") - F.count_if("complete")).alias("in_work"),
        F.sum("total").alias("chunks"), F.sum("done").alias("done"), F.sum("review").alias("review"), F.sum("open").alias("open"),
    )


def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    return tables.search(_current(spark, d, "project_id", "status", "raw_text", "normalized_text", "asr_text"), "pruefen", " Regen ").select("chunk_id", "project_id", "status", "total")


def lage_lookup(spark: SparkSession, d: str) -> DataFrame:
    chunks = _current(spark, d, "project_id", "lage")
    projects = table(spark, d, "projects").select(F.col("id").alias("project_id"), F.col("lage").alias("project_lage"), "voice")
    rows = chunks.join(projects, "project_id", "left").select("chunk_id", "voice", tables.effective_lage(F.col("lage"), F.col("project_lage")).alias("lage"))
    return tables.with_voice(rows, table(spark, d, "voices"), "voice", "lage")


def text_matches(spark: SparkSession, d: str) -> DataFrame:
    """Old states (with audio) against all chunks, per teil: which sound can be kept."""
    chunks = _current(spark, d, "project_id", "teil_no", "chunk_index", "normalized_text", "audio_file")
    old = chunks.where("audio_file is not null and audio_file != ''")
    m = tables.match_texts(old, chunks, ["project_id", "teil_no"], "normalized_text", "chunk_index")
    return m.groupBy("project_id", "teil_no").agg(
        F.count_if(F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()).alias("kept"), F.count_if(F.col("old_pos").isNull()).alias("new"), F.count_if(F.col("new_pos").isNull()).alias("removed"))


def option_groups(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variants")
    key = F.array_join(F.transform(tables.option_key(F.col("grid_options")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("bigint").cast("string"))), ",")
    return v.groupBy(key.alias("options"), "model", "lage").agg(F.count("*").alias("variants"), F.countDistinct("comparison_id").alias("comparisons"))


def merged_options(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variants").select("variant_id", "project_id", "grid_options")
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), "engine_options")
    merged = v.join(p, "project_id").select("variant_id", F.explode(tables.merge_options(F.col("engine_options"), F.col("grid_options"))).alias("key", "value"))
    return merged


def cleaned_options(spark: SparkSession, d: str) -> DataFrame:
    limits = {k: v for k, v in OPTIONS.items() if k != "cfg_strength"}
    return table(spark, d, "projects").select("id", F.explode(tables.clean_options(F.transform_values("engine_options", lambda k, v: v * 1.3), limits)).alias("key", "value"))


def best_variants(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variants")
    v = tables.best_flags(v, ["comparison_id"], "median_cer", True, "best_cer")
    v = tables.best_flags(v, ["comparison_id"], "median_similarity", False, "best_similarity")
    return v.select("variant_id", "comparison_id", "best_cer", "best_similarity")


def comparison_progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants").groupBy("comparison_id").agg(
        F.count_if(F.col("status").isin("done", "failed")).alias("finished"), F.count("*").alias("total"), F.every(F.col("status") == "done").alias("complete"),
        F.round(F.sum("duration_s"), 3).alias("seconds"))


def grid_variants(spark: SparkSession, d: str) -> DataFrame:
    g = tables.build_grid(table(spark, d, "comparisons"), GRID, OPTIONS)
    return g.select("id", "place", "model", "lage", F.element_at("options", "speed").alias("speed"), F.element_at("options", "nfe_step").alias("nfe_step"), "label")


def grid_reconfigure(spark: SparkSession, d: str) -> DataFrame:
    """Planned variants against the stored ones of each comparison: kept, new and removed."""
    key = lambda o: F.array_join(F.transform(tables.option_key(F.col(o)), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("bigint").cast("string"))), ",")
    empty = lambda x: F.coalesce(F.col(x), F.lit(""))
    new = tables.build_grid(table(spark, d, "comparisons"), {"speed": [0.8, 0.9, 1.0, 1.1]}, OPTIONS, most=10_000).select(F.col("id").alias("comparison_id"), key("options").alias("k"), empty("model").alias("model"), empty("lage").alias("lage"), F.lit(1).alias("n")).distinct()
    old = table(spark, d, "variants").select("comparison_id", key("grid_options").alias("k"), empty("model").alias("model"), empty("lage").alias("lage"), F.lit(1).alias("o")).distinct()
    both = new.join(old, ["comparison_id", "k", "model", "lage"], "full")
    return both.groupBy("comparison_id").agg(F.count_if(F.col("n").isNotNull() & F.col("o").isNotNull()).alias("kept"), F.count_if(F.col("o").isNull()).alias("new"), F.count_if(F.col("n").isNull()).alias("removed"))


def lists_of_comparisons(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*map(F.lit, ("neutral", "traurig", "ernst")))
    x = table(spark, d, "comparisons").select("id", F.array_distinct(F.filter("lagen", lambda v: v != "")).alias("l"), F.array_distinct("models").alias("m"))
    return x.select(
        "id", F.array_join(F.array_intersect("l", known), ",").alias("known"), F.array_join(tables.toggle(F.col("l"), known), ",").alias("toggled"),
        F.array_join(F.concat(F.array(F.lit("neutral")), F.array_except("l", F.array(F.lit("neutral")))), ",").alias("listed"), F.size("m").alias("models"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "projects").select("id", "name", F.try_to_timestamp(F.regexp_replace("created_at", "T", " ")).alias("at"), c.moment_text("created_at").alias("created"))
    return p.orderBy(F.desc("at"), "id").select("id", "name", "created")


def newest_projects(spark: SparkSession, d: str) -> DataFrame:
    """A top-five report: the limit is its purpose."""
    return catalog(spark, d).limit(5).select("id")


def project_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("id", c.slug("name", 40, "projekt").alias("slug"))


def unique_labels(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variants").select("variant_id", "comparison_id", c.slug("label").alias("slug"))
    return tables.unique_slugs(v, ["comparison_id"], "slug", "variant_id")


def sample_rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").groupBy("voice").agg(F.countDistinct("sample_rate").alias("rates"), (F.countDistinct("sample_rate") > 1).alias("mixed"), F.count("*").alias("projects"))


def lexicon_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Voices' words as a lexicon, with new entries in place of old ones."""
    old = table(spark, d, "voices").select(F.col("name").alias("word"), F.lit("alt").alias("spoken")).distinct()
    new = table(spark, d, "projects").select(F.col("voice").alias("word"), F.lit("neu").alias("spoken")).where("word is not null").distinct()
    return tables.upsert(old, new, "word").orderBy(F.lower("word"))


def acronym_candidates(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame([(k, v) for k, v in {**LEXICON, "KA": "Ka-A"}.items()], "word string, spoken string")
    texts = table(spark, d, "chunks").select("chunk_id", "project_id", "raw_text").distinct()
    found = tables.lexicon_candidates(texts, c.acronyms("raw_text"), lexicon, "project_id")
    return found.withColumn("spelled", c.spell_out("word"))


# ---- text


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teile").select("teil_id", "text").distinct()


def typography(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("teil_id", c.clean_typography("text").alias("text"))


def collapsed_space(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("teil_id", c.collapse_space(c.drop_links("text")).alias("text"))


def comparison_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "normalized_text").distinct().select("chunk_id", c.comparison_form(metrics.composed("normalized_text")).alias("form"))


def error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Character and word error rates of all transcribed chunks."""
    x = table(spark, d, "chunks").where("asr_text is not null").select("chunk_id", "normalized_text", "asr_text").distinct()
    return metrics.with_error_rates(x, "normalized_text", "asr_text").select("chunk_id", F.round("cer", 4).alias("cer"), F.round("wer", 4).alias("wer"))


def spoken_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "raw_text").distinct().select("chunk_id", german.spoken_column("raw_text", LEXICON).alias("spoken"))


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.chunk_texts(_texts(spark, d), ["teil_id"], rate=RATE)


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _texts(spark, d).select("teil_id", F.split("text", "\n").alias("l"))
    titled = F.transform("l", lambda x, i: F.struct(i.alias("line_no"), c.heading_text(x, F.get(F.col("l"), i + 1)).alias("title")))
    return lines.select("teil_id", F.inline(titled)).where("title is not null")


def joined_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the next one of its teil as one text. A join on position + 1: no window over a project."""
    x = table(spark, d, "chunks").select("project_id", "teil_no", "chunk_index", "chunk_id", "raw_text").distinct()
    nxt = x.select("project_id", "teil_no", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("raw_text").alias("next_text"))
    return x.join(nxt, ["project_id", "teil_no", "chunk_index"]).select("chunk_id", c.join_raw("raw_text", "next_text").alias("text"))


def rebuilt_texts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chunks").groupBy("project_id", "teil_no", "chunk_index", "raw_text").agg(F.max(F.coalesce("ends_paragraph", F.lit(False))).alias("ends_paragraph"))
    return ordered.paragraphs(x, ["project_id", "teil_no"], "chunk_index", "raw_text", "ends_paragraph")


def number_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 1_000_000).select(F.col("id").alias("n"), c.cardinal("id").alias("word"))


def ordinal_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 1000).select(F.col("id").alias("n"), c.ordinal("id").alias("word"))


def year_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000, 2200).select(F.col("id").alias("n"), c.year("id").alias("word"))


# ---- numbers and order


def chunk_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d, "project_id", "chunk_index", "attempts").select("chunk_id", c.derive_seed("project_id", "chunk_index", "attempts").alias("seed"))


def pause_timeline(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chunks").groupBy("project_id", "chunk_index", F.length("normalized_text").alias("n")).agg(
        F.max(F.coalesce("is_heading", F.lit(False))).alias("is_heading"), F.max(F.coalesce("ends_paragraph", F.lit(False))).alias("ends_paragraph"))
    x = x.withColumn("seconds", F.round(F.col("n") / RATE, 3)).drop("n")
    return ordered.timeline(x, ["project_id"], "chunk_index", "seconds", "is_heading", "ends_paragraph").select("project_id", "chunk_index", "seconds", "pause_s", F.round("start_s", 3).alias("start_s"))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that a transcription breaks, at the pace that its text would need."""
    x = _current(spark, d, "project_id", "normalized_text", "asr_text", "status").where("status in ('ok', 'needs_review', 'failed')")
    return x.select("chunk_id", recordings.reject_reason(F.col("asr_text"), F.length("normalized_text") / RATE).alias("reason"))


def reject_report(spark: SparkSession, d: str) -> DataFrame:
    r = reject_reasons(spark, d).where("reason is not null")
    return r.groupBy(F.substring_index("reason", " -- ", 1).alias("kind")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))


def voice_checks(spark: SparkSession, d: str) -> DataFrame:
    """All warnings of each recording, the pace that would be comfortable, and what a chunk may last beside it."""
    n = F.length(c.strip_space(F.coalesce("transcript", F.lit(""))))
    rate = F.when(n > 0, n / F.nullif(F.col("duration_s"), F.lit(0.0)))
    low, high = c.PLAUSIBLE_RATES
    w = F.array_compact(F.array(
        F.when(F.col("duration_s") < 5, "kurz"), F.when(F.col("duration_s") > 12, "lang"), F.when(F.col("sample_rate") < 16000, "rate"), F.when(rate < low, "wenig"), F.when(rate > high, "viel")))
    return table(spark, d, "voices").select(
        "name", "lage", F.array_join(w, ",").alias("warnings"), (F.col("duration_s") >= 1).alias("ok"), c.suggested_speed("chars_per_second").alias("speed"),
        F.round(c.chunk_budget(F.lit(20.0), F.lit(22.0), "duration_s"), 3).alias("budget"))


def training_plans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "variants").groupBy("model").agg(F.round(F.sum("duration_s"), 2).alias("seconds"))
    return s.select("model", "seconds", c.training_plan("seconds", F.lit(100)).alias("p"), c.duration_text("seconds").alias("duration")).select("model", "seconds", "p.*", "duration")


def voice_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    reference = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("reference"))
    return e.join(reference, "label").select("vec_id", F.round(metrics.cosine("embedding", "reference"), 6).alias("similarity"))


# ---- level series: a user's values are a recording's frames


def _frames(spark: SparkSession, d: str) -> DataFrame:
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select("user_id", "ts", "event_id", "value").select("user_id", frame.cast("bigint").alias("frame"), "value")


def speech_islands(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.runs(_frames(spark, d), ["user_id"], "frame", F.col("value") > 80.0, gap=3)
    return ordered.neighbour_gaps(found, ["user_id"]).select("user_id", "start", "end", "frames", "gap")


def inner_pauses(spark: SparkSession, d: str) -> DataFrame:
    return ordered.inner_runs(_frames(spark, d), ["user_id"], "frame", F.col("value") < 50.0, 3)


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Share of quiet frames at each threshold: the sweep is an array, so the series is read once."""
    x = _frames(spark, d).select("user_id", "value", F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10))).alias("threshold"))
    return x.groupBy("user_id", "threshold").agg(F.count_if(F.col("value") < F.col("threshold")).alias("quiet"), F.count("*").alias("frames"))


def level_background(spark: SparkSession, d: str) -> DataFrame:
    """The lowest median of 20 frames in a row, and the 95 % level."""
    w = Window.partitionBy("user_id").orderBy("frame")
    x = _frames(spark, d).withColumn("m", F.expr("percentile(value, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS 19 PRECEDING)")).withColumn("n", F.count("*").over(w.rowsBetween(-19, 0)))
    return x.groupBy("user_id").agg(
        F.round(F.coalesce(F.min(F.when(F.col("n") == 20, F.col("m"))), F.min("value")), 6).alias("floor"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("speech"))


def level_thresholds(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", c.decibel(F.col("value") / 500).alias("db"))
    x = x.groupBy("user_id").agg(F.min("db").alias("floor"), F.percentile("db", F.lit(0.95)).alias("speech"))
    return x.select("user_id", F.round(c.silence_threshold("floor", "speech"), 6).alias("threshold"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", "ts", "event_id", c.decibel(F.col("value") / 500).alias("db"))
    return x.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "db"))), lambda r: r["db"]).alias("levels"))


def recording_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of level series of 0.1 s frames."""
    return signal.find_segments(_series(spark, d), "user_id", "levels", frame=2400, rate=24000)


def recording_probe(spark: SparkSession, d: str) -> DataFrame:
    return signal.probe_recordings(_series(spark, d), "user_id", "levels")


def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    seconds = _series(spark, d).select(F.col("user_id").cast("string").alias("user_id"), (F.size("levels") / 10.0).alias("seconds"))
    return curation.probe_summary(recording_probe(spark, d), "user_id", seconds)


# ---- editing and curation


def merged_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every heading joined with the chunk after it."""
    x = table(spark, d, "chunks").groupBy("project_id", "chunk_index", "raw_text", "normalized_text").agg(
        F.max(F.coalesce("is_heading", F.lit(False))).alias("is_heading"), F.max(F.coalesce("ends_paragraph", F.lit(False))).alias("ends_paragraph"))
    out = editing.merge_chunks(x, x.where("is_heading").select("project_id", "chunk_index"))
    return out.select("project_id", "chunk_index", "raw_text", "is_heading", "ends_paragraph")


def utterance_figures(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and rejected transcriptions by engine, at the pace that their text would need."""
    x = reject_reasons(spark, d).join(_current(spark, d, "engine", "normalized_text", "asr_text"), "chunk_id")
    x = x.withColumn("engine", F.coalesce("engine", F.lit("-"))).withColumn("seconds", F.length("normalized_text") / RATE)
    return curation.dataset_figures(x.where("reason is null"), x.where("reason is not null"), ["engine"], "seconds", F.length("asr_text"))


def short_text_durations(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a share by bytes would give too little time beside their project's voice."""
    v = table(spark, d, "voices").where("lage = 'neutral'").select(F.col("name").alias("voice"), "transcript", "duration_s")
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), "voice").join(v, "voice")
    x = table(spark, d, "chunks").select("chunk_id", "project_id", "normalized_text").distinct().join(p, "project_id")
    return x.select("chunk_id", F.round(c.fixed_duration("normalized_text", "transcript", "duration_s", F.lit(1.0)), 3).alias("seconds")).where("seconds is not null")


def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """By project: texts over 20 seconds, texts whose first word asks for a pause, and the first words' number."""
    x = table(spark, d, "chunks").select("chunk_id", "project_id", "raw_text", "normalized_text").distinct()
    return x.groupBy("project_id").agg(
        F.count_if(c.over_length("normalized_text", F.lit(20.0))).alias("over"), F.count_if(c.expects_pause("raw_text")).alias("pauses"),
        F.countDistinct(F.regexp_extract(c.comparison_form("normalized_text"), r"^(\S+)", 1)).alias("first_words"))


def project_ids(spark: SparkSession, d: str) -> DataFrame:
    at = F.try_to_timestamp(F.regexp_replace("created_at", "T", " "))
    return table(spark, d, "projects").select("id", c.make_id("name", at).alias("made"))


QUERIES = {
    f.__name__: f
    for f in (
        project_progress, overview_counts, chunk_search, lage_lookup, text_matches, option_groups, merged_options, cleaned_options, best_variants, comparison_progress,
        grid_variants, grid_reconfigure, lists_of_comparisons, catalog, newest_projects, project_slugs, unique_labels, sample_rates, lexicon_upsert, acronym_candidates,
        typography, collapsed_space, comparison_forms, error_rates, spoken_forms, packed_chunks, heading_lines, joined_neighbours, rebuilt_texts, number_words, ordinal_words,
        year_words, chunk_seeds, pause_timeline, reject_reasons, reject_report, voice_checks, training_plans, voice_similarity, speech_islands, inner_pauses, threshold_sweep,
        level_background, level_thresholds, recording_segments, recording_probe, probe_summary,
        merged_headings, utterance_figures, short_text_durations, text_flags, project_ids,
    )
}

"""States of chunks: what is still to be made, what a run makes of it, and what a change of text or mood costs.

Every operator is a projection over the chunk table, joined where a change comes as a table of its own; a run is a bounded
number of such passes. Only what decides whether a project goes on is aggregated, so a project of any size is worked on by many
tasks. Columns that a table lacks are left alone.

Defined cases: a null state is no state (never open, never flagged); a null mood is unset; a null score is no measurement, and
a chunk without one counts as good; changes for chunks that don't exist do nothing; of repeated changes to one chunk the
greatest holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesewerk.functions.columns import derive_seed
from lesewerk.operators.ordered import join_keys
from lesewerk.operators.tables import effective_lage, match_texts
from lesewerk.session import ensure_checkpoint_dir

PENDING, SYNTHESIZED, GOOD, REVIEW, FAILED = "pending", "synthesized", "ok", "needs_review", "failed"
#: States that are to be rendered, checked, and looked at.
OPEN, UNCHECKED, FLAGGED = (PENDING, FAILED), (SYNTHESIZED,), (REVIEW, FAILED)
#: Error rate up to which a chunk is good, rounds after the first, and characters of an error that are kept.
MOST_ERRORS, RETRIES, ERROR_CHARS = 0.10, 2, 500
KEY = ["project_id", "chunk_index"]


def is_state(*states: str) -> Column:
    return F.coalesce(F.col("status").isin(*states), F.lit(False))


def pending_synthesis(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_state(*OPEN))


def pending_check(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_state(*UNCHECKED))


def flagged(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_state(*FLAGGED))


def _update(chunks: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    kinds = dict(chunks.dtypes)
    return chunks.withColumns({c: F.when(where, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items() if c in kinds})


def discard_sound(chunks: DataFrame, where: Column) -> DataFrame:
    """Back to pending with the same seed, so that only a changed setting is heard; the similarity stays."""
    none = F.lit(None)
    return _update(chunks, F.coalesce(where, F.lit(False)), {"status": F.lit(PENDING), "audio_file": none, "asr_text": none, "cer": none, "error": none})


def reroll(chunks: DataFrame, where: Column) -> DataFrame:
    """Back to pending with the next attempt's seed; the sound stays until it is made anew."""
    where, none = F.coalesce(where, F.lit(False)), F.lit(None)
    next_attempt = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    return _update(chunks, where, {"seed": derive_seed("project_id", "chunk_index", next_attempt), "attempts": next_attempt, "status": F.lit(PENDING), "asr_text": none, "cer": none, "error": none})


def retext(chunks: DataFrame, texts: DataFrame, spoken: Callable[[Column], Column]) -> DataFrame:
    """New texts (project_id, chunk_index, raw_text) with their spoken form; the chunks are rerolled."""
    new = texts.where("raw_text is not null").groupBy(*KEY).agg(F.max("raw_text").alias("_new"))
    both = join_keys(chunks, new, KEY, "left")
    hit = F.col("_new").isNotNull()
    out = both.withColumn("raw_text", F.coalesce("_new", "raw_text")).withColumn("normalized_text", F.when(hit, spoken(F.col("_new"))).otherwise(F.col("normalized_text")))
    return reroll(out, hit).drop("_new")


def refresh_spoken(chunks: DataFrame, spoken: Column) -> DataFrame:
    """The spoken forms made anew; only chunks whose form changes are rerolled."""
    marked = chunks.withColumn("_spoken", spoken)
    changed = ~F.col("_spoken").eqNullSafe(F.col("normalized_text"))
    marked = marked.withColumn("_changed", changed).withColumn("normalized_text", F.col("_spoken")).drop("_spoken")
    return reroll(marked, F.col("_changed")).drop("_changed")


def set_lage(chunks: DataFrame, projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Moods (project_id, chunk_index, lage) for chunks; ``projects`` is (project_id, lage). The sound goes only where the mood
    that holds, the project's included, is another one. Adds ``changed``."""
    new = wanted.groupBy(*KEY).agg(F.max(F.trim(F.coalesce("lage", F.lit("")))).alias("_wanted"))
    defaults = projects.groupBy("project_id").agg(F.max("lage").alias("_default"))
    both = join_keys(join_keys(chunks, new, KEY, "left"), defaults, ["project_id"], "left")
    asked = F.col("_wanted").isNotNull()
    changed = asked & (effective_lage(F.col("lage"), F.col("_default")) != effective_lage(F.col("_wanted"), F.col("_default")))
    both = both.withColumn("changed", changed).withColumn("lage", F.when(asked, F.col("_wanted")).otherwise(F.col("lage"))).drop("_wanted", "_default")
    return discard_sound(both, F.col("changed"))


def set_default_lage(chunks: DataFrame, projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """A new default mood (project_id, lage) of projects (project_id, lage), compared as it is written. The sound of chunks without a
    mood of their own goes. Adds ``changed``."""
    new = wanted.groupBy("project_id").agg(F.max(F.trim(F.coalesce("lage", F.lit("")))).alias("_wanted"))
    old = projects.groupBy("project_id").agg(F.max(F.coalesce("lage", F.lit(""))).alias("_default"))
    other = new.join(old, "project_id").where("_wanted != _default").select("project_id", F.lit(True).alias("_other"))
    both = join_keys(chunks, other, ["project_id"], "left")
    audible = F.coalesce(F.col("audio_file"), F.lit("")) != ""
    both = both.withColumn("changed", F.col("_other").isNotNull() & (F.coalesce("lage", F.lit("")) == "") & audible).drop("_other")
    return discard_sound(both, F.col("changed"))


# ---- a run


def rendered(chunks: DataFrame, where: Column, audio: Column, error: Column, engine: str) -> DataFrame:
    """What a rendering leaves behind: a sound to be checked, or a failure with the first characters of its error."""
    where = F.coalesce(where, F.lit(False))
    failed = where & error.isNotNull()
    out = _update(chunks, where & error.isNull(), {"status": F.lit(SYNTHESIZED), "audio_file": audio, "engine": F.lit(engine), "error": F.lit(None)})
    return _update(out, failed, {"status": F.lit(FAILED), "error": F.substring(error, 1, ERROR_CHARS)})


def checked(chunks: DataFrame, heard: Column | None, score: Callable[[Column, Column], Column] | None = None, most: float = MOST_ERRORS, among: Column | None = None) -> DataFrame:
    """Good or to be looked at, by the score of what was heard against the spoken form; the state is decided before the score is
    rounded. Without a transcription everything is good and nothing is measured. ``among`` narrows the chunks."""
    where = is_state(*UNCHECKED) if among is None else is_state(*UNCHECKED) & among
    if heard is None or score is None:
        return _update(chunks, where, {"status": F.lit(GOOD)})
    marked = chunks.withColumn("_heard", F.when(where, heard)).withColumn("_score", F.when(where, score(F.col("normalized_text"), F.col("_heard"))))
    state = F.when(F.coalesce(F.col("_score") <= most, F.lit(True)), F.lit(GOOD)).otherwise(F.lit(REVIEW))
    return _update(marked, where, {"asr_text": F.col("_heard"), "cer": F.round("_score", 4), "status": state}).drop("_heard", "_score")


def compared(chunks: DataFrame, similarity: Column, least: float = 0.0) -> DataFrame:
    """The similarity with the voice of all chunks with sound; it flags only under a threshold that was set. A null similarity is a
    measurement that failed and changes nothing."""
    marked = chunks.withColumn("_similarity", similarity)
    value = F.col("_similarity")
    where = (F.coalesce(F.col("audio_file"), F.lit("")) != "") & value.isNotNull()
    out = _update(marked, where, {"speaker_similarity": F.round(value, 4)})
    return (_update(out, where & (value < least), {"status": F.lit(REVIEW)}) if least > 0 else out).drop("_similarity")


def run_rounds(
    chunks: DataFrame, audio: Column, error: Column, heard: Column, score: Callable[[Column, Column], Column], engine: str, most: float = MOST_ERRORS, retries: int = RETRIES
) -> DataFrame:
    """A whole run: open chunks are rendered and checked; flagged ones are rerolled and done again, ``retries`` times at most.

    A project goes on only as long as the check flags one of its chunks, so failures alone aren't tried again; what is good, or was
    good before, isn't touched, which makes a run that is begun again go on where it was. ``audio``, ``error`` and ``heard`` are
    expressions over a chunk, its seed included. Each round is checkpointed, as the next one reads it twice."""
    ensure_checkpoint_dir(chunks.sparkSession)
    kinds = {"audio_file": "string", "asr_text": "string", "cer": "double", "error": "string", "engine": "string"}
    state = chunks.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in chunks.columns}).withColumn("_goes_on", F.lit(True))
    for attempt in range(retries + 1):
        todo = F.col("_goes_on") & is_state(*OPEN)
        asked = state.withColumn("_todo", todo).groupBy("project_id").agg(F.bool_or("_todo").alias("_any"))
        state = join_keys(state, asked, ["project_id"], "left").withColumn("_goes_on", F.col("_goes_on") & F.col("_any")).drop("_any")
        out = checked(rendered(state, F.col("_goes_on") & is_state(*OPEN), audio, error, engine), heard, score, most, F.col("_goes_on"))
        if attempt < retries:
            out = out.checkpoint()
            more = out.groupBy("project_id").agg(F.bool_or(is_state(REVIEW)).alias("_flags"))
            out = join_keys(out, more, ["project_id"], "left").withColumn("_goes_on", F.col("_goes_on") & F.col("_flags")).drop("_flags")
            out = reroll(out, F.col("_goes_on") & is_state(REVIEW)).checkpoint()
        state = out
    return state.drop("_goes_on")


# ---- a changed text


def kept_cuts(old_parts: DataFrame, new_parts: DataFrame, chunks: DataFrame, most_chars: int) -> DataFrame:
    """(project_id, teil_no, kept): whether a part keeps its cut. It does if it was cut by hand, its text is the same, and all its chunks,
    of which there is one at least, still fit. Parts are (project_id, teil_no, text, handschnitt)."""
    part = ["project_id", "teil_no"]
    old = old_parts.groupBy(*part).agg(F.max("text").alias("_old"), F.bool_or(F.coalesce("handschnitt", F.lit(False))).alias("_hand"))
    new = new_parts.groupBy(*part).agg(F.max("text").alias("text"))
    longest = chunks.groupBy(*part).agg(F.max(F.coalesce(F.length("normalized_text"), F.lit(0))).alias("_longest"))
    both = join_keys(join_keys(new, old, part, "left"), longest, part, "left")
    kept = F.col("_hand") & F.col("text").eqNullSafe(F.col("_old")) & (F.col("_longest") <= most_chars)
    return both.select(*part, F.coalesce(kept, F.lit(False)).alias("kept"))


def reconfigure(chunks: DataFrame, cut: DataFrame, parts: DataFrame, same_voice: bool = True) -> DataFrame:
    """The chunks of changed projects. ``parts`` is the result of ``kept_cuts``; ``cut`` holds the fresh chunks (project_id, teil_no,
    chunk_index, raw_text, normalized_text, ends_paragraph, is_heading) of all new parts, numbered by project.

    Parts that keep their cut keep their chunks; in the others a fresh chunk takes over the sound, the seed and the measures of an old
    one with the same spoken form, the n-th of equal ones from the n-th, over all parts of the project. With another voice, engine
    or model nothing sounds on. (chunks' columns, origin): 'kept', 'matched' or 'new'; renumber them by (teil_no, chunk_index)."""
    part = ["project_id", "teil_no"]
    flags = parts.select(*part, F.col("kept").alias("_kept"))
    old = join_keys(chunks, flags, part, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    stays = old.where("_kept").drop("_kept").withColumn("origin", F.lit("kept"))
    fresh = join_keys(cut, flags, part).where(~F.col("_kept")).drop("_kept")
    free = old.where(~F.col("_kept") & (F.coalesce(F.col("audio_file"), F.lit("")) != "")).drop("_kept")
    if not same_voice:
        stays, free = discard_sound(stays, F.lit(True)), free.where(F.lit(False))
    pairs = match_texts(free, fresh, ["project_id"], "normalized_text", "chunk_index").where("new_pos is not null")
    taken = join_keys(pairs.select("project_id", F.col("new_pos").alias("chunk_index"), F.col("old_pos").alias("_from")), fresh, KEY)
    rest = [c for c in chunks.columns if c not in fresh.columns]
    source = free.select("project_id", F.col("chunk_index").alias("_from"), *rest)
    made = join_keys(taken, source, ["project_id", "_from"], "left").withColumn("origin", F.when(F.col("_from").isNull(), "new").otherwise("matched"))
    begin = {"status": F.lit(PENDING), "attempts": F.lit(0), "seed": derive_seed("project_id", "chunk_index", F.lit(0)), "lage": F.lit("")}
    made = _update(made, F.col("origin") == "new", begin)
    return stays.unionByName(made.select(*chunks.columns, "origin"))


def reconfigure_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, kept, new, removed): chunks with sound, chunks made, and old chunks that found no place."""
    old = before.groupBy("project_id").agg(F.count("*").alias("_old"))
    sounds = F.coalesce(F.col("audio_file"), F.lit("")) != ""
    got = after.groupBy("project_id").agg(
        F.count_if(sounds).alias("kept"), F.count_if(F.col("origin") == "new").alias("new"), F.count_if(F.col("origin") != "new").alias("_survived"))
    both = old.join(got, "project_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("project_id", zero("kept").alias("kept"), zero("new").alias("new"), (zero("_old") - zero("_survived")).alias("removed"))

"""Changes to the chunk sequence of many projects at once: insert, merge, renumber.

Positions are renumbered by a running count over stretches of positions, so a project of any size is renumbered by many
tasks. What belongs to a chunk's sound is dropped where its text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesewerk.functions.columns import derive_seed, join_raw
from lesewerk.operators.ordered import join_keys, running_sum

#: What is measured on a chunk's sound.
SOUND = ("audio_file", "asr_text", "cer", "speaker_similarity", "trimmed_bleed_s", "engine", "error")


def without_sound(chunks: DataFrame, where: Column) -> DataFrame:
    """Resets the sound and all that was measured on it, and the state, of the rows that ``where`` holds for."""
    kinds = dict(chunks.dtypes)
    out = {c: F.when(where, F.lit(None).cast(kinds[c])).otherwise(F.col(c)) for c in SOUND if c in kinds}
    if "status" in kinds:
        out["status"] = F.when(where, F.lit("pending")).otherwise(F.col("status"))
    return chunks.withColumns(out)


def renumber(chunks: DataFrame, project: str = "project_id", order: str = "_order", index: str = "chunk_index") -> DataFrame:
    """Numbers each project's chunks from 0 by a unique integer order; the order column goes."""
    counted = running_sum(chunks.drop(index).withColumn("_one", F.lit(1)), [project], order, "_one", index)
    return counted.withColumn(index, F.col(index).cast("int")).drop("_one", order)


def insert_chunks(chunks: DataFrame, inserts: DataFrame, spoken: Column | None = None) -> DataFrame:
    """Puts new texts (project_id, chunk_index, after, raw_text) before or after a chunk, at most one on each side of it.

    A text before a chunk joins its paragraph; one after it takes over its end of paragraph. Blank texts and those of
    unknown chunks are left out. ``spoken`` is the spoken form, by default the text itself."""
    new = inserts.withColumn("raw_text", F.trim("raw_text")).where("raw_text != ''").groupBy("project_id", "chunk_index", F.coalesce("after", F.lit(False)).alias("after")).agg(F.min("raw_text").alias("new_text"))
    takes_end = new.where("after").select("project_id", "chunk_index", F.lit(True).alias("_taken"))
    marked = join_keys(chunks, takes_end, ["project_id", "chunk_index"], "left")
    old = marked.withColumn("_order", F.col("chunk_index").cast("bigint") * 3 + 1)
    added = join_keys(old, new, ["project_id", "chunk_index"]).withColumn("_order", F.col("_order") + F.when(F.col("after"), 1).otherwise(-1))
    added = added.withColumn("ends_paragraph", F.col("ends_paragraph") & F.col("after")).withColumn("raw_text", F.col("new_text"))
    added = added.withColumns({"normalized_text": F.col("raw_text") if spoken is None else spoken, "is_heading": F.lit(False), "attempts": F.lit(0)} if "attempts" in chunks.columns else {"normalized_text": F.col("raw_text") if spoken is None else spoken, "is_heading": F.lit(False)})
    added = without_sound(added, F.lit(True)).withColumn("_new", F.lit(True)).drop("new_text", "after", "_taken")
    kept = old.withColumn("ends_paragraph", F.col("ends_paragraph") & F.col("_taken").isNull()).drop("_taken").withColumn("_new", F.lit(False))
    out = renumber(kept.unionByName(added))
    if "seed" in chunks.columns:
        out = out.withColumn("seed", F.when(F.col("_new"), derive_seed("project_id", "chunk_index", F.lit(0))).otherwise(F.col("seed")))
    return out.drop("_new").select(*chunks.columns)


def merge_chunks(chunks: DataFrame, merges: DataFrame, spoken: Column | None = None) -> DataFrame:
    """Joins chunks (project_id, chunk_index) with the next one. A chunk that follows a merged one isn't merged itself.

    The joined chunk is a heading only if both were, ends a paragraph if the second did, and loses its sound."""
    asked = merges.select("project_id", "chunk_index").distinct()
    earlier = asked.select("project_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.lit(True).alias("_follows"))
    first = join_keys(asked, earlier, ["project_id", "chunk_index"], "left").where("_follows is null").select("project_id", "chunk_index")
    following = chunks.select("project_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("raw_text").alias("_raw"), F.col("normalized_text").alias("_spoken"), F.col("ends_paragraph").alias("_ends"), F.col("is_heading").alias("_heading"))
    pairs = join_keys(first, following, ["project_id", "chunk_index"])
    gone = pairs.select("project_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.lit(True).alias("_gone"))
    rows = join_keys(join_keys(chunks, pairs, ["project_id", "chunk_index"], "left"), gone, ["project_id", "chunk_index"], "left").where("_gone is null")
    merged = F.col("_raw").isNotNull()
    out = rows.withColumns({
        "raw_text": F.when(merged, join_raw("raw_text", "_raw")).otherwise(F.col("raw_text")), "ends_paragraph": F.when(merged, F.col("_ends")).otherwise(F.col("ends_paragraph")),
        "is_heading": F.when(merged, F.col("is_heading") & F.col("_heading")).otherwise(F.col("is_heading"))})
    out = out.withColumn("normalized_text", F.when(merged, F.concat_ws(" ", "normalized_text", "_spoken") if spoken is None else spoken).otherwise(F.col("normalized_text")))
    out = without_sound(out.withColumn("_merged", merged).drop("_raw", "_spoken", "_ends", "_heading", "_gone"), F.col("_merged"))
    out = renumber(out.withColumn("_order", F.col("chunk_index").cast("bigint")))
    if "seed" in chunks.columns:
        out = out.withColumn("seed", F.when(F.col("_merged"), derive_seed("project_id", "chunk_index", F.lit(0))).otherwise(F.col("seed")))
    return out.drop("_merged").select(*chunks.columns)

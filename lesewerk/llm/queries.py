"""Queries of the training-data operators on the test tables. Problem N's queries are named pN_..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lesewerk.llm import bpe, lookalikes, mixing, packing, percentiles, sentences, spam, splitting
from lesewerk.llm.common import fold_name, items, latest, table

#: Seconds of a take where a project names none, and characters a second where its voice has no measured rate.
TARGET_SECONDS, CHARS_PER_SECOND = 20.0, 14.0
#: Steps of the kept counts of cer and speaker_similarity; percentiles are at most half a step off.
RESOLUTION = 0.001
TARGETS = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}


# ---- 1 splitting


def _sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    teile = table(spark, sf_dir, "teile").select(F.lit("teil").alias("item_kind"), F.col("teil_id").alias("item_id"), F.lit(None).cast("string").alias("engine"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "engine", F.col("raw_text").alias("text"))
    return teile.unionByName(chunks)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(_sized_items(spark, sf_dir), table(spark, sf_dir, "size_limits"), with_text=False)
    return pieces.where("piece_no = 0").select("item_kind", "item_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_sized_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


# ---- 2 look-alikes


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    counts = lookalikes.count_bigrams(chunks, "normalized_text", "asr_text")
    return lookalikes.hidden_differences(chunks, "chunk_id", "normalized_text", "asr_text", counts).select(F.col("chunk_id").cast("bigint").alias("chunk_id"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "normalized_text", "asr_text").distinct()
    return lookalikes.canonical_texts(chunks, "chunk_id", "normalized_text", "asr_text")


# ---- 3 packing


def _take_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks once each, with the size of their raw text and the capacity of their project's takes."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "project_id", "teil_no", F.length("raw_text").alias("size"), F.xxhash64("raw_text").alias("same_text"))
    chunks = chunks.where("chunk_id is not null and project_id is not null").groupBy("chunk_id", "project_id").agg(F.max("size").alias("size"), F.max("teil_no").alias("teil_no"), F.max("same_text").alias("same_text"))
    voices = table(spark, sf_dir, "voices").where("lage = 'neutral'").groupBy(F.col("name").alias("voice")).agg(F.max("chars_per_second").alias("rate"))
    projects = table(spark, sf_dir, "projects").groupBy(F.col("id").alias("project_id")).agg(F.max(F.struct("target_chunk_seconds", "voice")).alias("p")).select("project_id", "p.*")
    rate = F.when(F.col("rate") > 0, F.col("rate")).otherwise(F.lit(CHARS_PER_SECOND))
    seconds = F.coalesce(F.when(F.col("target_chunk_seconds") > 0, F.col("target_chunk_seconds")), F.lit(TARGET_SECONDS))
    capacity = projects.join(voices, "voice", "left").select("project_id", F.floor(seconds * rate + 1e-9).cast("bigint").alias("capacity"))
    default = F.lit(int(TARGET_SECONDS * CHARS_PER_SECOND))
    return chunks.join(capacity, "project_id", "left").withColumn("capacity", F.coalesce("capacity", default))


def p3_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_take_items(spark, sf_dir), "project_id", "chunk_id", "size", "capacity")


def p3_takes_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with conflicts: no take holds two chunks of one teil, or two copies of one text."""
    return packing.pack(_take_items(spark, sf_dir), "project_id", "chunk_id", "size", "capacity", source="teil_no", cluster="same_text")


# ---- 4 sentences


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(items(table(spark, sf_dir, "teile"), table(spark, sf_dir, "chunks")))


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(items(table(spark, sf_dir, "teile"), table(spark, sf_dir, "chunks")), with_text=True)


# ---- 5 percentiles


def _cer() -> Column:
    return percentiles.measured(F.col("cer"), low=0.0)


def _similarity() -> Column:
    """Similarity as a share: values above 1 are in percent."""
    s = percentiles.measured(F.col("speaker_similarity"), low=-1.0, high=100.0)
    return F.when(s > 1.0, s / 100.0).otherwise(s)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = latest(table(spark, sf_dir, "chunks"), "chunk_id", "project_id", "cer")
    exact = percentiles.percentiles(percentiles.partial_counts(state.where("project_id is not null"), ["project_id"], _cer()), ["project_id"], {"median": 0.5})
    stored = table(spark, sf_dir, "variants").where("status = 'done' and median_cer is not null and variant_id is not null")
    both = stored.select("variant_id", "project_id", "median_cer").join(exact, "project_id", "left")
    # stored values have at most six digits, so the difference is compared on that grid
    off = F.isnan("median_cer") | F.col("median").isNull() | (F.round(F.abs(F.col("median_cer") - F.col("median")), 9) > 0.01)
    return both.where(off).select(F.col("variant_id").cast("bigint").alias("variant_id")).distinct()


def _measured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = latest(table(spark, sf_dir, "chunks"), "chunk_id", "project_id", "engine", "saved_at", "cer", "speaker_similarity")
    voices = table(spark, sf_dir, "projects").groupBy(F.col("id").alias("project_id")).agg(F.max("voice").alias("voice"))
    return state.join(voices, "project_id", "left").withColumn("day", F.to_date("saved_at"))


def _chunk_percentiles(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    groups = ["project_id", "engine", "voice", "day"]
    by_day = percentiles.partial_counts(_measured_chunks(spark, sf_dir), groups, value, RESOLUTION)
    out = percentiles.percentiles(by_day, groups, TARGETS, RESOLUTION)
    return out.select(*groups, "n", "error_bound", *[F.round(F.col(t), 6).alias(t) for t in TARGETS])


def p5_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_percentiles(spark, sf_dir, _cer())


def p5_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_percentiles(spark, sf_dir, _similarity())


def p5_similarity_by_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the days' kept counts, over fewer groups than they were kept for."""
    by_day = percentiles.partial_counts(_measured_chunks(spark, sf_dir), ["voice", "day"], _similarity(), RESOLUTION)
    out = percentiles.percentiles(percentiles.combine([by_day], ["voice"]), ["voice"], TARGETS, RESOLUTION)
    return out.select("voice", "n", "error_bound", *[F.round(F.col(t), 6).alias(t) for t in TARGETS])


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = percentiles.measured(F.col("median_cer"), low=0.0)
    variants = table(spark, sf_dir, "variants").select("variant_id", "comparison_id", "median_cer").distinct()
    out = percentiles.percentiles(percentiles.partial_counts(variants, ["comparison_id"], value), ["comparison_id"], TARGETS)
    return out.select("comparison_id", "n", "error_bound", *[F.round(F.col(t), 6).alias(t) for t in TARGETS])


# ---- 6 tokens


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_corpus(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids")


# ---- 7 mixture


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[1]


def p7_mixture_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the weighted sources have: what short sources can't give is redistributed."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), total=mixing.CORPUS)[0]


def p7_shares_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), total=mixing.CORPUS)[1]


#: Domains of the sources, for a tree of three levels.
DOMAINS = {
    "buch": ("roman", "sachbuch", "gedicht", "handbuch"), "netz": ("webseite", "zeitung", "forum"), "ton": ("vortrag", "hoerspiel", "radioarchiv"),
}


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As many tokens as the weighted sources have, over domain, language and source: what a source can't give goes to the sources of its
    domain and language first, then to the domain's other languages, then to the other domains."""
    of = F.create_map(*[F.lit(x) for domain, sources in DOMAINS.items() for s in sources for x in (s, domain)])
    documents = table(spark, sf_dir, "documents").withColumn("domain", F.try_element_at(of, F.coalesce(fold_name(F.col("source")), F.lit(""))))
    return mixing.mix(documents, table(spark, sf_dir, "source_weights"), total=mixing.CORPUS, levels=("domain", "lang", "source"))


def p7_mixture_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0]


def p7_shares_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[1]


# ---- 8 stuffed pages


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("bigint").alias("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_forms, p3_takes, p3_takes_varied, p4_found, p4_units, p5_found, p5_cer, p5_similarity, p5_similarity_by_voice, p5_variants,
        p6_ids, p7_mixture, p7_shares, p7_mixture_corpus, p7_shares_corpus, p7_mixture_tree, p7_shares_tree, p8_found,
    )
}

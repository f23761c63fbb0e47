"""Data sets of utterances: accepted and rejected parts, their figures, what a probe says, which files belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lesewerk.operators.ordered import join_keys


def number_accepted(segments: DataFrame, reason: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) segments. Accepted ones are numbered from 1 over all sources in order: counts of each source are
    summed before it, so that only a source's own segments are counted in one task. ``order`` begins with the source."""
    marked = segments.withColumn("reason", reason)
    source = order[0]
    good = marked.where("reason is null").drop("reason")
    sizes = good.groupBy(source).agg(F.count("*").alias("_n"))
    before = sizes.select(source, F.coalesce(F.sum("_n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return good.withColumn("_k", inside).join(before, source).withColumn("number", F.col("_before") + F.col("_k")).drop("_k", "_before"), marked.where("reason is not null")


def dataset_figures(accepted: DataFrame, rejected: DataFrame, keys: list[str], seconds: str, chars: Column) -> DataFrame:
    """Segments, minutes, median length and pace of the accepted, number and minutes of the rejected; 0 where there are none.
    Without keys it is one row over all, or none if there is nothing at all."""
    if not keys:
        one = lambda df: df.withColumn("_all", F.lit(1))
        return dataset_figures(one(accepted), one(rejected), ["_all"], seconds, chars).drop("_all")
    a = accepted.groupBy(*keys).agg(F.count("*").alias("segments"), (F.sum(seconds) / 60).alias("minutes"), F.median(seconds).alias("median_s"), F.median(F.when(F.col(seconds) > 0, chars / F.col(seconds)).otherwise(0.0)).alias("median_pace"))
    r = rejected.groupBy(*keys).agg(F.count("*").alias("rejected"), (F.sum(seconds) / 60).alias("rejected_minutes"))
    both = a.join(r, keys, "full")
    return both.select(*keys, *[F.coalesce(F.round(c, 6), F.lit(0)).alias(c) for c in ("segments", "minutes", "median_s", "median_pace", "rejected", "rejected_minutes")])


def probe_summary(rows: DataFrame, key: str, seconds: DataFrame, most_s: float = 15.0) -> DataFrame:
    """What a probe says of each recording: whether any threshold is of use, the best one (of equals the lowest), and whether the
    pauses found by the threshold in use suffice to cut the recording to pieces of ``most_s``. ``seconds`` is (key, seconds)."""
    best = F.when(F.col("usable"), F.struct("pauses_split", (-F.col("threshold_db")).alias("t")))
    per = rows.groupBy(key).agg((~F.bool_or("usable")).alias("hopeless"), (-F.max(best)["t"]).alias("best_db"), F.max(F.when(F.col("used"), F.col("pauses_split"))).alias("found"))
    need = F.greatest(F.ceil(F.col("seconds") / most_s) - 1, F.lit(0))
    return per.join(seconds, key).select(key, "hopeless", "best_db", F.coalesce("found", F.lit(0)).alias("found"), need.alias("needed"), (F.coalesce("found", F.lit(0)) >= need).alias("enough"))


def stale_outputs(files: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds whether any part (keys, modified) is younger than the output (keys, modified); no output is never stale."""
    newest = files.groupBy(*keys).agg(F.max("modified").alias("_newest"))
    return outputs.join(newest, keys, "left").withColumn("stale", F.coalesce(F.col("_newest") > F.col("modified"), F.lit(False))).drop("_newest")


def model_files(files: DataFrame, key: str, name: str = "name", bigvgan: bool = False) -> DataFrame:
    """(key, checkpoint, vocabulary): the checkpoint by kind, format, 'last', step and length of name; the vocabulary beside it, else the flattest."""
    n, low = F.col(name), F.lower(name)
    stem = F.regexp_replace(F.regexp_extract(n, r"[^/]+$", 0), r"\.[^.]*$", "")
    steps = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.cast("bigint"))), F.lit(0))
    rank = F.struct((low.contains("bigvgan") != F.lit(bigvgan)).alias("a"), (~n.endswith(".safetensors")).alias("b"), (~low.contains("last")).alias("c"), (-steps).alias("d"), F.length(n).alias("e"), n.alias("f"))
    picked = files.where(n.rlike(r"\.(safetensors|pt)$")).groupBy(key).agg(F.min_by(n, rank).alias("checkpoint"))
    folder = lambda c: F.regexp_replace(c, r"/?[^/]+$", "")
    vocab = files.where(F.regexp_extract(n, r"[^/]+$", 0) == "vocab.txt").join(picked, key)
    place = F.struct((folder(n) != folder(F.col("checkpoint"))).alias("a"), (F.length(n) - F.length(F.replace(n, F.lit("/"), F.lit("")))).alias("b"), F.length(n).alias("c"), n.alias("d"))
    return vocab.groupBy(key).agg(F.first("checkpoint").alias("checkpoint"), F.min_by(n, place).alias("vocabulary"))


def checkpoint_order(files: DataFrame, name: str = "name") -> DataFrame:
    """Checkpoints with the last one first, then by falling step; a name without a step comes last."""
    step = F.coalesce(F.regexp_extract(name, r"model_(\d+)\.pt$", 1).try_cast("bigint"), F.lit(-1))
    return files.where(F.col(name).rlike(r"model_[^/]*\.pt$")).orderBy(~F.col(name).endswith("model_last.pt"), F.desc(step), name)


def recorded(variants: DataFrame, measures: DataFrame, project: str) -> DataFrame:
    """Variants with the measures of their projects in place of their own; a project without measures leaves nulls."""
    stale = [c for c in measures.columns if c != project and c in variants.columns]
    return variants.drop(*stale).join(measures, project, "left").select(*[c for c in variants.columns if c not in stale and c != project], *[c for c in measures.columns if c != project])


def longest_reference(rows: DataFrame, voices: DataFrame, voice: str = "voice", name: str = "name", seconds: str = "duration_s") -> DataFrame:
    """The other columns of ``rows`` with the seconds of their voice's longest recording, 0 for unknown voices."""
    longest = voices.groupBy(F.col(name).alias(voice)).agg(F.max(seconds).alias("seconds"))
    return rows.join(longest, voice, "left").select(*[c for c in rows.columns if c != voice], F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def first_rows(findings: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group (0: all) and, as ``more``, how many others it has. Spark keeps only so many rows of a group
    in each task before the shuffle."""
    if not most:
        return findings.withColumn("more", F.lit(0).cast("bigint"))
    first = findings.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
    sizes = findings.groupBy(*keys).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return join_keys(first, sizes, keys)


def of_status(results: DataFrame, *states: str, status: str = "status") -> DataFrame:
    """Results of a report with one of the states; 'fail' alone says whether the report is good."""
    return results.where(F.col(status).isin(*states))


def require_variants(grid: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, variants) of the groups that are too small to compare; raise on what comes back, or leave them out."""
    return grid.groupBy(key).agg(F.count("*").alias("variants")).where(F.col("variants") < least)


def settings_for(rows: DataFrame, models: DataFrame, model: str = "model", name: str = "name", values: tuple[str, ...] = ("ckpt_path", "vocab_path")) -> DataFrame:
    """Settings with those of the named model in their place; without a model, or with an unknown one, they stay."""
    found = models.groupBy(F.col(name).alias("_model")).agg(*[F.max(v).alias(f"_{v}") for v in values])
    return rows.join(found, rows[model] == F.col("_model"), "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in values else rows[c] for c in rows.columns])


def without_lage(voices: DataFrame, gone: DataFrame) -> DataFrame:
    """Recordings (name, lage, ...) without those named; the neutral one goes only with its voice, so it stays."""
    asked = gone.select("name", "lage").distinct().where("lage != 'neutral'")
    return voices.join(asked, ["name", "lage"], "left_anti")


def with_transcripts(voices: DataFrame, texts: DataFrame) -> DataFrame:
    """New transcripts (name, lage, transcript) for recordings, with the pace that follows from them."""
    new = texts.groupBy("name", "lage").agg(F.max("transcript").alias("_new"))
    both = voices.join(new, ["name", "lage"], "left").withColumn("transcript", F.coalesce("_new", "transcript"))
    pace = F.when((F.length(F.trim("transcript")) > 0) & (F.col("duration_s") > 0), F.length(F.trim("transcript")) / F.col("duration_s"))
    return both.withColumn("chars_per_second", F.when(F.col("_new").isNotNull(), pace).otherwise(F.col("chars_per_second"))).drop("_new").select(*voices.columns)

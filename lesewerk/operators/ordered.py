"""Ordered operators: running sums over groups of any size, runs of flags, and folds that a window can't express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the stretches of positions in which a running sum is kept.
STRETCH = 4096


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], kind: str = "inner") -> DataFrame:
    """Join on keys in which null equals null; the columns of ``a`` and those of ``b`` that aren't keys."""
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    rest = [F.col(f"b.{c}") for c in b.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), on, kind).select(*[F.col(f"a.{c}") for c in a.columns], *rest)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group, by the integer column ``order``.

    A window over a whole group would put a group of a third of all rows into one task. Here the rows of a stretch of
    positions are summed by themselves, and the sums of the stretches before are added; a task holds one stretch.
    Null values count as 0; rows of equal position are in an undefined order, so give a unique one.
    """
    parts = df.withColumn("_stretch", F.floor(F.col(order) / stretch).cast("bigint"))
    sums = parts.groupBy(*keys, "_stretch").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_here"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_here").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_here")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = join_keys(parts.withColumn("_inside", inside), before, [*keys, "_stretch"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def runs(df: DataFrame, keys: list[str], position: str, flag: Column, gap: int = 1) -> DataFrame:
    """Islands of flagged positions as (keys, start, end, frames), end exclusive; islands less than ``gap`` apart are one.

    Only flagged rows are shuffled and sorted, by recording. Null flags count as false."""
    w = Window.partitionBy(*keys).orderBy(position)
    hit = df.where(F.coalesce(flag, F.lit(False))).select(*keys, position)
    apart = hit.withColumn("_new", F.when(F.col(position) - F.lag(position).over(w) - 1 < gap, 0).otherwise(1))
    return (
        apart.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.count("*").alias("frames"))
        .drop("_run")
    )


def inner_runs(df: DataFrame, keys: list[str], position: str, flag: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` flagged positions that touch neither end of their recording, with their number and the longest
    run of all, edges included: (keys, pauses, longest). Recordings without a run have zeros."""
    ends = df.groupBy(*keys).agg(F.min(position).alias("_first"), (F.max(position) + 1).alias("_last"))
    found = runs(df, keys, position, flag)
    joined = join_keys(ends, found, keys, "left")
    length = F.col("end") - F.col("start")
    inner = (length >= least) & (F.col("start") > F.col("_first")) & (F.col("end") < F.col("_last"))
    return joined.groupBy(*keys).agg(F.sum(F.when(inner, 1).otherwise(0)).alias("pauses"), F.coalesce(F.max(length), F.lit(0)).alias("longest"))


def neighbour_gaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the distance of each run to its nearest neighbour; null for a single one."""
    w = Window.partitionBy(*keys).orderBy("start")
    return found.withColumn("gap", F.least(F.col("start") - F.lag("end").over(w), F.lead("start").over(w) - F.col("end")))


def timeline(chunks: DataFrame, keys: list[str], order: str, seconds: str, heading: str, paragraph: str, pauses: tuple[float, float, float] = (0.35, 0.8, 1.2)) -> DataFrame:
    """Adds start_s and pause_s of each chunk on the finished track: after a heading the longest pause, after a paragraph the
    middle one, else the short one, and none after the last chunk."""
    last = chunks.groupBy(*keys).agg(F.max(order).alias("_end"))
    both = join_keys(chunks, last, keys)
    pause = F.when(F.col(order) == F.col("_end"), 0.0).when(F.col(heading), pauses[2]).when(F.col(paragraph), pauses[1]).otherwise(pauses[0])
    spans = both.withColumn("pause_s", pause).withColumn("_ms", F.round((F.coalesce(F.col(seconds), F.lit(0.0)) + F.col("pause_s")) * 1000).cast("bigint"))
    return running_sum(spans.drop("_end"), keys, order, "_ms", "_start").withColumn("start_s", F.col("_start") / 1000).drop("_ms", "_start")


def paragraphs(chunks: DataFrame, keys: list[str], order: str, text: str, ends: str) -> DataFrame:
    """The text of each group: chunks joined by spaces to paragraphs, paragraphs by blank lines.

    A group is one source text, so its parts fit a row as the text itself does."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.coalesce(F.col(ends), F.lit(False)).alias("e"))))
    joined = F.aggregate(parts, F.lit(""), lambda a, p: F.concat(a, p["t"], F.when(p["e"], "\n\n").otherwise(" ")))
    return chunks.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.rtrim(joined, F.lit("\n ")).alias(text))

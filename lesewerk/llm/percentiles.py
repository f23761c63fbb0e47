"""Percentiles of very large numeric columns, per group, from partial results that can be kept and combined.

Method: cumulative frequencies. A partial result is a table of (group, range, value, count); two of them are combined by
adding counts, so days and partitions can be kept apart and merged in any order. The percentile search sorts each group's
values by range, adds the counts of the ranges before as an offset, opens only the ranges that a target rank falls into, and
takes the first value whose running sum reaches the rank.

Ranges are cut by magnitude, ``CELLS`` to each doubling: a range spans less than 0.07 % of its value, whether the column holds
shares, bytes or both. So values that lie close together are parted as well as values over many orders of magnitude, a group
has at most some thousands of ranges for each factor of ten, and no task gets more of a group than the distinct values of one
range. The cut is a function of the value alone, not of a sample: a task that is run again cuts alike.

Error: with ``resolution`` r values are rounded to multiples of r; a percentile is then at most r / 2 off. With resolution
None the counts are kept for the exact values and the percentile is exact.

Null, NaN and, where ``low`` or ``high`` say so, values outside the measured range don't count. Groups without a measured
value have no row. Percentiles between two ranks are interpolated linearly; so the median of an even count is the mean of
the middle two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values for each doubling, and the number that brings the smallest magnitude of a double to 1.
CELLS = 1024
SMALLEST = 1075 * CELLS


def measured(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """The value if it is a measurement: not null, not NaN, finite and within the bounds; else null."""
    v = value.cast("double")
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    if low is not None:
        ok &= v >= low
    if high is not None:
        ok &= v <= high
    return F.when(ok, v)


def range_of(value: Column, cells: int = CELLS) -> Column:
    """Number of a value's range; it rises with the value, zero is 0, and negative values mirror positive ones."""
    place = F.floor(F.log2(F.abs(value)) * cells).cast("bigint") + SMALLEST // CELLS * cells + 1
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(F.signum(value).cast("bigint") * place)


def partial_counts(df: DataFrame, groups: list[str], value: str | Column, resolution: float | None = None, cells: int = CELLS) -> DataFrame:
    """(groups, range_no, value, n) of the rows with a value. Counts are added before the shuffle."""
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    # + 0.0 makes one value of both zeros
    kept = df.select(*groups, (v if resolution is None else F.round(v / resolution) * F.lit(resolution)).alias("value")).where(measured(F.col("value")).isNotNull())
    kept = kept.withColumn("value", F.col("value") + F.lit(0.0))
    counted = kept.groupBy(*groups, "value").agg(F.count("*").alias("n"))
    return counted.select(*groups, range_of(F.col("value"), cells).alias("range_no"), "value", "n")


def combine(partials: list[DataFrame], groups: list[str]) -> DataFrame:
    """One partial result of several, also over fewer groups than they have (a year's from its days')."""
    every = reduce(DataFrame.unionByName, [p.select(*groups, "range_no", "value", "n") for p in partials])
    return every.groupBy(*groups, "range_no", "value").agg(F.sum("n").alias("n"))


def percentiles(partial: DataFrame, groups: list[str], targets: dict[str, float], resolution: float | None = None) -> DataFrame:
    """(groups, n, error_bound, one column for each target) of a partial result; ``targets`` maps names to shares in [0, 1]."""
    counts = combine([partial], groups)
    by_range = counts.groupBy(*groups, "range_no").agg(F.sum("n").alias("here"))
    w = Window.partitionBy(*groups)
    ranges = by_range.select(
        *groups, "range_no", "here",
        F.coalesce(F.sum("here").over(w.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(w).alias("total"),
    )
    # linear interpolation between the values at two ranks, counted from 1
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(targets.values())])
    rank = F.col("t.p") * (F.col("total") - 1)
    wanted = (
        ranges.select(*groups, "range_no", "here", "before", "total", F.explode(spots).alias("t"))
        .select("*", F.explode(F.array(F.struct(F.lit(0).alias("up"), F.floor(rank).alias("at")), F.struct(F.lit(1).alias("up"), F.ceil(rank).alias("at")))).alias("w"))
        .where("w.at + 1 > before and w.at + 1 <= before + here")
        .select(*groups, "range_no", "before", "total", F.col("t.k").alias("k"), F.col("w.up").alias("up"), (F.col("w.at") + 1).alias("rank"))
    )
    spots_of = wanted.groupBy(*groups, "range_no").agg(F.first("before").alias("before"), F.first("total").alias("total"), F.collect_list(F.struct("k", "up", "rank")).alias("wanted"))
    g = [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in groups]
    opened = counts.alias("c").join(spots_of.alias("s"), reduce(Column.__and__, [*g, F.col("c.range_no") == F.col("s.range_no")])).select("c.*", "before", "total", "wanted")
    inside = Window.partitionBy(*groups, "range_no").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = opened.withColumn("upto", F.col("before") + F.sum("n").over(inside)).select("*", F.explode("wanted").alias("x")).where("x.rank <= upto and x.rank > upto - n")
    ends = reached.groupBy(*groups, F.col("x.k").alias("k")).agg(
        F.max("total").alias("total"), F.min(F.when(F.col("x.up") == 0, F.col("value"))).alias("lower"), F.max(F.when(F.col("x.up") == 1, F.col("value"))).alias("upper"))
    columns = []
    for k, (name, p) in enumerate(targets.items()):
        share = F.lit(float(p)) * (F.col("total") - 1) - F.floor(F.lit(float(p)) * (F.col("total") - 1))
        columns.append(F.max(F.when(F.col("k") == k, F.col("lower") + (F.col("upper") - F.col("lower")) * share)).alias(name))
    return ends.groupBy(*groups).agg(F.max("total").alias("n"), F.lit(0.0 if resolution is None else resolution / 2).alias("error_bound"), *columns)

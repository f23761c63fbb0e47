"""Filling containers of fixed capacity with items, best fit first, under conflicts.

Method: conflict-constrained best fit. Items come in falling size; open bins are kept in the order of their room and carry
a bitmap of the sources and one of the duplicate clusters in them. The search begins at the first bin with enough room and
goes on to its successors until the tightest compatible one is found; if there is none, a bin is opened.

Items of equal size, source and cluster are interchangeable, so the search runs over such classes with counts: bins that are
alike are one entry with a multiplicity, and a class fills as many of them as it needs at once. The packing step sees only
classes, never items, so a group that holds a third of all rows costs it nothing more. Without conflicts a group has at most
as many classes as its capacity has values, and is always searched whole. With conflicts nearly every item can be a class of
its own; a group of more than ``block_classes`` of them is dealt out to blocks of about that many, each of which leaves the
few part-filled bins that one search leaves.

Items are shuffled once, by class and salt. Their ranks in their class are counted in these salted parts, so no task sees a
whole hot class; the packing step turns the parts' sizes into the runs of bins that each part fills.

An item that exceeds the capacity is split into parts of exactly the capacity and one rest, which is packed like an item;
all others stay whole. Defined cases: items of size 0 go to the fullest compatible bin; a null or negative size counts as
0; rows whose group or capacity is null are left out, and a capacity below 1 counts as 1; a null source or cluster conflicts
with nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the ranks of a class are counted, and classes of a group with conflicts that one packing step holds.
SALTS, BLOCK_CLASSES = 64, 1 << 18
#: Width of a bin's bitmaps. Sources or clusters beyond it share bits; where bits meet, the few keys of the bin decide.
BITS = 1024


def best_fit(classes: list[tuple[int, int, int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs classes (size, source, cluster, count); -1 conflicts with nothing.

    Returns (class number, first rank, items, items in each bin, first bin) of each run, and the number of bins. A run's
    items fill bins first bin, first bin + 1, ... with that many items each.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    # (room, first bin, multiplicity, source bitmap, cluster bitmap, keys), by room; the first bin is unique
    open_bins: list[tuple[int, int, int, int, int, tuple]] = []
    order = sorted(range(len(classes)), key=lambda c: (-classes[c][0], -classes[c][3], c))
    for c in order:
        size, source, cluster, count = classes[c]
        sources = 1 << source % BITS if source >= 0 else 0
        clusters = 1 << cluster % BITS if cluster >= 0 else 0
        keys = ((0, source),) * (source >= 0) + ((1, cluster),) * (cluster >= 0)
        alone = bool(keys)
        rank = 0
        at = bisect_left(open_bins, (size,))
        while rank < count:
            while at < len(open_bins):
                b = open_bins[at]
                if (b[3] & sources or b[4] & clusters) and any(k in b[5] for k in keys):
                    at += 1  # the successor is the next tightest
                else:
                    break
            if at < len(open_bins):
                room, first, many, has_sources, has_clusters, has = open_bins.pop(at)
            else:
                per = 1 if alone else count if not size else max(1, capacity // size)
                room, first, many, has_sources, has_clusters, has = capacity, bins, -(-(count - rank) // per), 0, 0, ()
                bins += many
            each = 1 if alone else count - rank if not size else room // size
            full = min(many, (count - rank) // each)
            if full:
                runs.append((c, rank, full * each, each, first))
                rank += full * each
                insort(open_bins, (room - each * size, first, full, has_sources | sources, has_clusters | clusters, has + keys))
            if full < many and (left := count - rank):
                runs.append((c, rank, left, left, first + full))
                rank = count
                insort(open_bins, (room - left * size, first + full, 1, has_sources | sources, has_clusters | clusters, has + keys))
                full += 1
            if full < many:
                insort(open_bins, (room, first + full, many - full, has_sources, has_clusters, has))
            at = bisect_left(open_bins, (size,))
    return runs, bins


def _cut_runs(salts: list[int], sizes: list[int], runs: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(salt, places) of a class: its (first rank, items, each, first bin) runs, cut to the ranks of each of its salted parts.
    A place is (first rank in the part, items of the run before it, items in each bin, first bin of the run)."""
    begin, k = 0, 0
    for salt, size in sorted(zip(salts, sizes, strict=True)):
        end = begin + size
        while runs[k][0] + runs[k][1] <= begin:
            k += 1
        j, places = k, []
        while j < len(runs) and runs[j][0] < end:
            first_rank, _, each, first_bin = runs[j]
            places.append((max(first_rank - begin, 0), max(begin - first_rank, 0), each, first_bin))
            j += 1
        yield salt, places
        begin = end


_PLACE = [pa.field(name, pa.int64()) for name in ("from", "skip", "each", "bin")]


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, cap, members) to (g, block, bins, size, src, clu, salt, places)."""
    for batch in batches:
        members = batch.column("members")
        flat, ends = members.flatten(), members.offsets.to_pylist()
        size, src, clu, n = (flat.field(c).to_pylist() for c in ("size", "src", "clu", "n"))
        parts = flat.field("parts")
        part_ends, part = parts.offsets.to_pylist(), parts.flatten()
        salts, counts = part.field("salt").to_pylist(), part.field("m").to_pylist()
        first_end, first_part = ends[0], part_ends[0]
        rows: list[tuple[int, int, int]] = []  # (row, member, bins)
        out_salts, lengths, places = [], [0], []
        for row, cap in enumerate(batch.column("cap").to_pylist()):
            here = range(ends[row] - first_end, ends[row + 1] - first_end)
            # a source or cluster of one item conflicts with nothing: it takes no bit
            items: tuple[Counter, Counter] = Counter(), Counter()
            for k in here:
                items[0][src[k]] += n[k]
                items[1][clu[k]] += n[k]
            numbers: tuple[dict, dict] = {}, {}

            def number(which: int, key: int, numbers=numbers, items=items) -> int:
                return -1 if key == NONE or items[which][key] < 2 else numbers[which].setdefault(key, len(numbers[which]))

            order = sorted(here, key=lambda k: (size[k], src[k], clu[k]))
            runs, bins = best_fit([(size[k], number(0, src[k]), number(1, clu[k]), n[k]) for k in order], cap)
            of: dict[int, list] = {}
            for c, *run in runs:
                of.setdefault(c, []).append(tuple(run))
            for c, class_runs in of.items():
                k = order[c]
                a, b = part_ends[k] - first_part, part_ends[k + 1] - first_part
                for salt, found in _cut_runs(salts[a:b], counts[a:b], sorted(class_runs)):
                    rows.append((row, k, bins))
                    out_salts.append(salt)
                    places += found
                    lengths.append(len(places))
        at, member = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
        columns = list(zip(*places, strict=True)) or [()] * 4
        inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=_PLACE)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("g").take(at), batch.column("block").take(at), pa.array([r[2] for r in rows], pa.int64()), *[flat.field(c).take(member) for c in ("size", "src", "clu")],
                pa.array(out_salts, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), inner),
            ],
            ["g", "block", "bins", "size", "src", "clu", "salt", "places"],
        )


#: Source or cluster of a row that has none.
NONE = 0


def pack(items: DataFrame, group: str, item: str, size: str, capacity: str, source: str | None = None, cluster: str | None = None, bin_name: str = "take_no", salts: int = SALTS, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """(group, item, part_no, part_start, part_size, bin_name): the bin, from 0 in each group, of each part of each item.

    Give one row for each item; ``capacity`` is a column that is the same in all rows of a group (the smallest one holds).
    Two items of one source, or of one cluster, never share a bin. With a source or cluster, a group of more than
    ``block_classes`` classes is packed in blocks of about that many; without, never.
    """
    # the hash of a key is never NONE
    conflict = lambda name: F.when(F.col(name).isNull(), F.lit(NONE)).otherwise(F.coalesce(F.nullif(F.xxhash64(name), F.lit(NONE)), F.lit(1))).cast("bigint")
    conflicts = [(c, name) for c, name in (("src", source), ("clu", cluster)) if name]
    base = items.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("len"),
        F.when(F.col(capacity).isNotNull(), F.greatest(F.col(capacity).cast("bigint"), F.lit(1))).alias("cap"), *[conflict(name).alias(c) for c, name in conflicts],
    ).where("g is not null and i is not null and cap is not null")
    key = ["g", "size", *[c for c, _ in conflicts]]
    # Both the counts and the ranks come from this one shuffle, and the packing runs once: Spark uses an exchange again only
    # if all who read it ask for the same columns and rows: so rows are sorted as whole structs, counts name every column, and
    # the filters that joins add stand before the exchange.
    known = lambda columns: reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    parts = (
        base.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("len") / F.col("cap")) - 1, F.lit(0)))).alias("part_no", "_"))
        .select(
            *key[:1], F.least(F.col("len") - F.col("part_no") * F.col("cap"), F.col("cap")).alias("size"), *key[2:],
            F.pmod(F.xxhash64("i", "part_no"), F.lit(salts)).cast("int").alias("salt"), F.struct("i", "part_no", "cap").alias("row"))
        .where(known([*key, "salt"]))
        .repartition(*key, "salt")
    )
    one_part = Window.partitionBy(*key, "salt")
    ranked = parts.select("*", (F.row_number().over(one_part.orderBy("row")) - 1).alias("r"), F.count("*").over(one_part).alias("m"))
    classes = (
        ranked.where("r = 0").groupBy(*key)
        .agg(F.sum("m").alias("n"), F.min("row.cap").alias("cap"), F.collect_list(F.struct("salt", "m")).alias("parts"))
    )
    if conflicts:
        blocks = classes.groupBy("g").agg(F.ceil(F.count_if((F.col("n") > 0) & (F.col("cap") > 0) & (F.size("parts") > 0)) / F.lit(block_classes)).cast("int").alias("blocks"), F.min("cap").alias("gcap"))
        members = classes.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    else:
        members = classes.withColumn("block", F.lit(0)).withColumn("gcap", F.col("cap"))
    none = [F.lit(NONE).cast("bigint").alias(c) for c in ("src", "clu") if c not in key]
    listed = (
        members.select("*", *none).groupBy("g", "block")
        .agg(F.min("gcap").alias("cap"), F.collect_list(F.struct("size", "src", "clu", "n", "parts")).alias("members"))
    )
    g = listed.schema["g"].dataType.simpleString()
    placed = listed.mapInArrow(
        _pack_blocks, f"g {g}, block int, bins bigint, size bigint, src bigint, clu bigint, salt int, places array<struct<from:bigint,skip:bigint,each:bigint,bin:bigint>>"
    ).select(*key, "salt", "block", "bins", "places").where(known([*key, "salt", "block"])).repartition(*key, "salt")
    offset = F.lit(0)
    if conflicts:  # the bins of a block are numbered behind those of the blocks before it
        whole = (F.size("places") > 0) & known([*key, "salt"])
        sizes = placed.groupBy("g", "block").agg(F.max(F.when(whole, F.col("bins"))).alias("bins"))
        before = sizes.select("g", "block", F.coalesce(F.sum("bins").over(Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
        placed = placed.join(before, ["g", "block"]).withColumn("offset", F.when(F.col("bins") > 0, F.col("offset")))
        offset = F.col("offset")
    both = ranked.join(placed.drop("block", "bins"), [*key, "salt"])
    place = F.element_at(F.filter("places", lambda p: p["from"] <= F.col("r")), -1)
    return both.withColumn("p", place).select(
        F.col("g").alias(group), F.col("row.i").alias(item), F.col("row.part_no").cast("int").alias("part_no"), (F.col("row.part_no") * F.col("row.cap")).alias("part_start"),
        F.col("size").alias("part_size"), (offset + F.col("p.bin") + F.floor((F.col("r") - F.col("p.from") + F.col("p.skip")) / F.col("p.each"))).cast("bigint").alias(bin_name),
    )

"""Splitting oversized texts at natural boundaries, with overlap.

Method: pointer doubling. Every boundary of a text is joined to its farthest legal successor, the overlap included; the
successor table is squared again and again, and the set of reached boundaries doubles each time, so all cuts of the greedy
walk are derived in about log2(pieces) array steps for all texts of a batch at once, not piece by piece.

Boundaries are, from the best to the last: blank lines, sentence ends, clause marks, white space and, where a stretch has
none of them for longer than a piece, places between two characters that aren't part of one cluster. A successor is the
farthest boundary of the best kind that fills at least ``fill`` of the room; the last kind is taken wherever it lies.

Each piece but the first begins ``overlap`` code points before the end of the one before it; joined without the overlaps
the pieces are the text. Texts at or below their limit, nulls and empty texts give no piece. The limit must exceed the
overlap; if it doesn't, the overlap is cut to half the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lesewerk.llm.common import fold_name
from lesewerk.llm.sentences import unit_ends

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_CLAUSE = re.compile(r"[,;:،؛、，；：)\]–—]+[\"”“»«›‹’」』]*\s*")
_SPACE = re.compile(r"\s+")
_AFTER_SPACE = re.compile(r"\s*")
#: Code points of text that are worked on at once.
SLICE = 8 << 20


def _grows(c: str) -> bool:
    """Whether a character belongs to the one before it."""
    return unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf", "Sk") or "\U0001f3fb" <= c <= "\U0001f3ff"


def boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, kinds) of a text's boundaries; 0 and the length are the first and the last. No gap is wider than ``room``."""
    kind: dict[int, int] = {}
    for m in _SPACE.finditer(text):
        kind[m.end()] = 3
    for m in _CLAUSE.finditer(text):
        kind[m.end()] = 2
    for e in unit_ends(text):
        kind[_AFTER_SPACE.match(text, e).end()] = 1
    for m in _BLANK.finditer(text):
        kind[m.end()] = 0
    n = len(text)
    kind.pop(0, None)
    if n:
        kind[n] = 0
    out, last = [(0, 0)], 0
    for p in sorted(kind):
        while p - last > room:
            q = last + room
            while q > last + 1 and _grows(text[q]):
                q -= 1
            if q == last + 1:
                q = last + room  # a cluster that is longer than a piece
            out.append((q, 4))
            last = q
        out.append((p, kind[p]))
        last = p
    a = np.array(out, dtype=np.int64)
    return a[:, 0], a[:, 1]


def successors(at: np.ndarray, kinds: np.ndarray, item: np.ndarray, most: np.ndarray, overlap: np.ndarray, fill: float) -> np.ndarray:
    """Index of each boundary's farthest legal successor. ``at`` rises over all texts (each text is moved behind the one before);
    ``item`` has each boundary's text, ``most`` and ``overlap`` the text's limits. The last boundary of a text is its own."""
    count = len(at)
    index = np.arange(count)
    first = np.searchsorted(item, item, side="left")
    last = np.searchsorted(item, item, side="right") - 1
    begin = np.where(index == first, at, at - overlap[item])  # of the piece that goes on from this boundary
    limit = np.minimum(begin + most[item], at[last])
    least = at + np.maximum(1, (fill * (limit - at)).astype(np.int64))
    least = np.where(index == first, np.maximum(least, at + overlap[item]), least)  # the first piece holds a whole overlap
    best = np.searchsorted(at, limit, side="right") - 1  # of any kind
    for k in (3, 2, 1, 0):  # a better kind takes the place of a worse one
        of = np.flatnonzero(kinds <= k)
        j = of[np.maximum(np.searchsorted(at[of], limit, side="right") - 1, 0)]
        best = np.where((at[j] >= least) & (at[j] <= limit), j, best)
    best = np.where(limit == at[last], last, best)
    return np.maximum(best, np.minimum(index + 1, last))


def reached(step: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All boundaries on the walks from ``starts``: with each squaring of the table the set of known ones doubles."""
    known = starts
    while True:
        new = step[known]
        both = np.unique(np.concatenate([known, new]))
        if len(both) == len(known):
            return known
        known, step = both, step[step]


def cut(texts: list[str], most: np.ndarray, overlap: np.ndarray, fill: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of all pieces of the texts, in order."""
    if not texts:
        return (np.zeros(0, np.int64),) * 3
    most = np.maximum(np.asarray(most, dtype=np.int64), 1)
    overlap = np.asarray(overlap, dtype=np.int64)
    overlap = np.where(overlap < most, np.maximum(overlap, 0), most // 2)
    parts = [boundaries(t, int(m - o)) for t, m, o in zip(texts, most, overlap, strict=True)]
    sizes = np.array([len(p[0]) for p in parts])
    item = np.repeat(np.arange(len(texts)), sizes)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    at = np.concatenate([p[0] for p in parts]) + base[item]
    step = successors(at, np.concatenate([p[1] for p in parts]), item, most, overlap, fill)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    on = reached(step, first)
    on = on[~np.isin(on, first)]  # what is left are the ends of pieces
    of, end = item[on], at[on] - base[item[on]]
    again = np.concatenate([[False], of[1:] == of[:-1]])
    start = np.where(again, np.concatenate([[0], end[:-1]]) - overlap[of], 0)
    return of, np.maximum(start, 0), end


def with_limits(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds max_chars and overlap_chars: the row of the item's kind and engine, else the kind's row '*'.

    Of repeated rows the smallest limit and the greatest overlap hold; items whose kind has no row are left out. The limits
    are a table of few rows that Spark broadcasts where its measured size allows it and joins by shuffle elsewhere.
    """
    rows = limits.where("item_kind is not null and max_chars is not null").groupBy("item_kind", fold_name(F.col("engine")).alias("engine")).agg(
        F.min("max_chars").cast("bigint").alias("max_chars"), F.max(F.coalesce("overlap_chars", F.lit(0))).cast("bigint").alias("overlap_chars")
    )
    by_kind = rows.groupBy("item_kind").agg(
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("engine", F.lit("*")), F.struct("max_chars", "overlap_chars")))).alias("_limits")
    )
    found = F.coalesce(F.try_element_at("_limits", F.coalesce(fold_name(F.col("engine")), F.lit("*"))), F.try_element_at("_limits", F.lit("*")))
    return items.join(by_kind, "item_kind").withColumn("_limit", found).where("_limit is not null").select(*items.columns, "_limit.max_chars", "_limit.overlap_chars")


def split_oversized(items: DataFrame, limits: DataFrame, fill: float = 0.5, with_text: bool = True) -> DataFrame:
    """Pieces (item_kind, item_id, piece_no, start_pos, end_pos, n_pieces[, piece]) of the (item_kind, item_id, engine, text) rows whose
    text is longer than its limit. Only the oversized rows are shuffled, to put duplicate rows together; an item that several engines'
    limits apply to is cut by the smallest."""
    big = (
        with_limits(items.select("item_kind", "item_id", "engine", "text").where("text is not null and item_id is not null"), limits)
        .where(F.length("text") > F.col("max_chars"))
        .groupBy("item_kind", "item_id", "text")
        .agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
        .select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), "text", "max_chars", "overlap_chars")
    )
    names = ["item_kind", "item_id", "piece_no", "start_pos", "end_pos", "n_pieces"] + ["piece"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(2)), 0).to_numpy())
            stops = np.searchsorted(sizes, np.arange(SLICE, sizes[-1] + SLICE, SLICE)) + 1 if len(sizes) else []
            begin = 0
            for stop in dict.fromkeys(min(int(s), whole.num_rows) for s in stops):
                batch = whole.slice(begin, stop - begin)
                begin = stop
                if not batch.num_rows:
                    continue
                texts = batch.column(2).to_pylist()
                of, start, end = cut(texts, batch.column(3).to_numpy(), batch.column(4).to_numpy(), fill)
                counts = np.bincount(of, minlength=len(texts))
                no = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
                rows = pa.array(of)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(no, pa.int32()), pa.array(start), pa.array(end), pa.array(counts[of], pa.int32())]
                if with_text:
                    columns.append(pa.array([texts[i][a:b] for i, a, b in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "item_kind string, item_id bigint, piece_no int, start_pos bigint, end_pos bigint, n_pieces int" + ", piece string" * with_text
    return big.mapInArrow(run, schema)

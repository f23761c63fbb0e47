"""Byte-level BPE encoding of a whole corpus with a public tokenizer's rank file.

Method: a text is cut by the tokenizer's pattern; each piece is merged with a priority queue of merge ranks over a
doubly linked list of symbols, stale queue entries are skipped. A worker merges every distinct piece once and keeps its
ids. Decoding concatenates the vocabulary's byte strings.

Null and empty texts have the empty list. Names of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lesewerk.llm.common import TOKENIZERS

#: Fixed value: the pattern that splits text before the merges, as the tokenizer's README names it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A rank file above this size isn't sent to the workers.
MOST_VOCABULARY_BYTES = 32 << 20
#: Pieces that a worker keeps at once and the longest that it keeps; beyond that it starts anew. It only affects speed.
KEPT_PIECES, KEPT_LENGTH = 1 << 19, 128
#: Code points of the texts that are turned into ids at once.
SLICE = 4 << 20


def read_ranks(path: str | None = None) -> bytes:
    """The rank file's bytes; ``path`` defaults to byte_bpe_50k.tiktoken."""
    path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    if (n := os.path.getsize(path)) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {n} bytes, more than {MOST_VOCABULARY_BYTES}")
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. The queue holds (rank, left, right, end); an entry whose symbols changed since is stale."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # a symbol is piece[i:end[i]]; end[i] == 0 once it is merged into its left neighbour
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # stale: the left symbol is gone or one of the two has grown
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(queue, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Piece -> its ids as little-endian int32 bytes, merged at the first request."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), dtype="<i4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes by one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pieces = Pieces(ranks)
        self.split = regex.compile(pattern).findall

    def encode_bytes(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "strings"):
            self.strings = {v: k for k, v in self.pieces.ranks.items()}
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(data: bytes) -> Encoder:
    """One encoder for each vocabulary and Python worker; it outlives a task, as the worker does."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(data))
    return _ENCODERS[key]


def _slices(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, int, list]]:
    """Runs of rows of a bounded amount of text, so that one batch of long texts doesn't hold all its ids twice."""
    column, start, size = batch.column(i), 0, 0
    for stop, n in enumerate(pc.binary_length(column).to_pylist(), 1):
        size += n or 0
        if size >= SLICE or stop == len(column):
            yield start, stop, column.slice(start, stop - start).to_pylist()
            start, size = stop, 0


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(key, ids): one row for each row of ``df``, without a shuffle. Repeated rows stay repeated, null keys stay null."""
    data = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(data.value).encode_bytes
        for batch in batches:
            for start, stop, texts in _slices(batch, 1):
                parts = [encode(t) for t in texts]
                offsets = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], ["k", "ids"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str = "text", name: str = "n_tokens", ranks_path: str | None = None) -> DataFrame:
    """``df`` without the text and with the number of its ids; null and empty texts have 0."""
    data = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in df.columns if c not in (text, name)]
    source = df.select(*kept, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(data.value).encode_bytes
        for batch in batches:
            n = [len(encode(t)) // 4 for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) if kept else ""
    return source.mapInArrow(run, f"{schema}{', ' if kept else ''}`{name}` bigint")

"""Interface of models that run on rows, with deterministic stand-ins. No real model is included.

A model is a factory: it is made once in each Python worker and called with batches, so that a large one is loaded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]
FACTORIES: dict[str, Callable[..., Model]] = {}


def register(name: str) -> Callable[[Callable[..., Model]], Callable[..., Model]]:
    def keep(factory: Callable[..., Model]) -> Callable[..., Model]:
        FACTORIES[name] = factory
        return factory

    return keep


def apply_model(rows: DataFrame, name: str, schema: str, **options) -> DataFrame:
    """Rows through a registered model, batch by batch; the schema is that of its result."""
    if name not in FACTORIES:
        raise KeyError(f"unknown model {name!r}; there are {', '.join(sorted(FACTORIES))}")
    factory = FACTORIES[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(**options)
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


@register("echo")
def echo(corrupt: int = 0) -> Model:
    """Hears what was written; if the seed is a multiple of ``corrupt``, words are lost. (id, text, seed) -> (id, heard)."""

    def hear(text: str | None, seed: int) -> str | None:
        if text is None or not corrupt or seed % corrupt:
            return text
        return " ".join(w for i, w in enumerate(text.split()) if i % 2)

    return lambda b: pd.DataFrame({"id": b["id"], "heard": [hear(t, s) for t, s in zip(b["text"], b["seed"], strict=True)]})


@register("hash-embedding")
def hash_embedding(size: int = 16) -> Model:
    """A vector of a text's hash: equal texts are alike, others aren't. (id, text) -> (id, vector)."""

    def vector(text: str | None) -> list[float] | None:
        if text is None:
            return None
        out: list[float] = []
        while len(out) < size:
            out += [b / 127.5 - 1 for b in hashlib.sha256(f"{len(out)}:{text}".encode()).digest()]
        return out[:size]

    return lambda b: pd.DataFrame({"id": b["id"], "vector": [vector(t) for t in b["text"]]})


@register("spectrum-embedding")
def spectrum_embedding(bands: int = 64) -> Model:
    """A vector of a recording's spectrum: logarithms of the mean magnitudes of equal bands. (id, samples) -> (id, vector)."""

    def vector(samples) -> list[float] | None:
        if samples is None:
            return None
        size = np.abs(np.fft.rfft(np.asarray(samples, dtype=np.float64))) if len(samples) else np.zeros(1)
        return [float(np.log1p(part.mean())) if len(part) else 0.0 for part in np.array_split(size, bands)]

    return lambda b: pd.DataFrame({"id": b["id"], "vector": [vector(s) for s in b["samples"]]})


def lufs_gain(loudness: Column, peak: Column, target: float = -16.0, ceiling: float = -1.0) -> Column:
    """Gain in dB to a wanted loudness that keeps the peak below the ceiling; null loudness is left alone (gain 0)."""
    return F.when(loudness.isNull(), 0.0).otherwise(F.least(F.lit(target) - loudness, F.lit(ceiling) - peak))

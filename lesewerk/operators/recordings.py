"""Recordings as rows of samples: trimming, fading, resampling, start judgement, checks, tracks and data sets.

Samples are arrays of a row, (key, rate, samples); each operator works on its rows in Arrow batches without a shuffle. Only a
track needs its parts in order: they are gathered by track, as a track is one file.

Defined cases: null samples give a null result; empty ones stay empty; a rate of 0 or null has no duration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesewerk.functions.columns import PLAUSIBLE_RATES, comparison_form, expects_pause, strip_space
from lesewerk.operators import curation, signal

#: Peak bounds in dB of an utterance and of a reference, and characters that a transcription needs.
LOUDEST, UTTERANCE_QUIETEST, REFERENCE_QUIETEST, LEAST_CHARS = -0.5, -35.0, -30.0, 5
#: A lead-in is looked for from this second on, in a window around the heard beginning of the text.
LEAST_LEAD_IN, WINDOW_BEFORE, WINDOW_AFTER = 0.15, 0.15, 0.05
BATCH_ROWS = 64


def _map_samples(rows: DataFrame, made: dict[str, str], work: Callable[..., tuple], *inputs: str) -> DataFrame:
    """Adds (or replaces) columns that ``work`` makes of the input columns of each row; the other columns pass through as they are."""
    keep = [c for c in rows.columns if c not in made]
    source = rows.select(*keep, *[F.col(c).alias(f"_in{k}") for k, c in enumerate(inputs)])
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], *[f"`{c}` {t}" for c, t in made.items()]])
    kinds = {"array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BATCH_ROWS) for k in range(0, batch.num_rows, BATCH_ROWS)):  # samples are large
                columns = [part.column(len(keep) + k).to_pylist() for k in range(len(inputs))]
                got = [work(*row) for row in zip(*columns, strict=True)]
                out = [pa.array([g[k] for g in got], kinds[t]) for k, t in enumerate(made.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], [*keep, *made])

    return source.mapInArrow(run, schema)


def _array(samples: list | None) -> np.ndarray:
    return np.array([0.0 if v is None else v for v in samples], dtype=np.float32)


def trim_recordings(rows: DataFrame, samples: str = "samples", rate: str = "rate", db: float = signal.TRIM_DB, margin_ms: int = 40) -> DataFrame:
    """Without the silence at both ends, but for a margin; a recording without a loud frame becomes empty."""
    work = lambda x, r: (None if x is None or not r else signal.trim(_array(x), r, db, margin_ms).tolist(),)
    return _map_samples(rows, {samples: "array<float>"}, work, samples, rate)


def fade_recordings(rows: DataFrame, samples: str = "samples", rate: str = "rate", ms: int = 12) -> DataFrame:
    """Both ends faded by a linear ramp, unless the recording is shorter than both ramps."""
    return _map_samples(rows, {samples: "array<float>"}, lambda x, r: (None if x is None or not r else signal.fade(_array(x), r, ms).tolist(),), samples, rate)


def resample_recordings(rows: DataFrame, to: int, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Another rate, by linear interpolation."""
    work = lambda x, r: (None if x is None or not r else signal.resample(_array(x), r, to).tolist(), to)
    return _map_samples(rows, {samples: "array<float>", rate: "int"}, work, samples, rate)


def frame_levels(rows: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Adds ``levels``: dB of the frames of 10 ms."""
    return _map_samples(rows, {"levels": "array<double>"}, lambda x, r: (None if x is None or not r else signal.levels(_array(x), r).tolist(),), samples, rate)


def judge_starts(rows: DataFrame, text: str = "raw_text", samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Adds ``cut`` and ``reason``: where a stray sound at the beginning ends, or why nothing is cut."""
    marked = rows.withColumn("_pause", expects_pause(text))

    def work(x: list | None, r: int | None, pause: bool) -> tuple:
        return (None, None) if x is None or not r else signal.judge_start(signal.levels(_array(x), r), bool(pause))

    return _map_samples(marked, {"cut": "double", "reason": "string"}, work, samples, rate, "_pause").drop("_pause")


def cut_lead_ins(rows: DataFrame, words: str = "words", spoken: str = "normalized_text", raw: str = "raw_text", samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Takes a rest of the reference away from the beginning. ``words`` is the transcription as array<struct<text,start,end>>.

    Where the first words of the text were heard late enough, the cut is the last quiet place before them and the words before it
    are dropped; else the shape of the beginning decides. Adds ``trimmed_bleed_s`` and ``heard``."""
    form = lambda c: F.filter(F.split(comparison_form(c), " "), lambda w: w != "")
    marked = rows.withColumn("_expected", form(F.col(spoken))).withColumn("_pause", expects_pause(raw))
    marked = marked.withColumn("_heard", F.transform(words, lambda w: comparison_form(w["text"]))).withColumn("_starts", F.transform(words, lambda w: w["start"])).withColumn("_texts", F.transform(words, lambda w: w["text"]))

    def work(x: list | None, r: int | None, expected: list | None, pause: bool, heard: list | None, starts: list | None, texts: list | None) -> tuple:
        texts = [t or "" for t in texts or []]
        said = " ".join(texts)
        if x is None or not r:
            return x, None, said
        a = _array(x)
        at, before = signal.content_start([{"word": w, "start": s} for w, s in zip(heard or [], starts or [], strict=True)], expected or [])
        if at is not None and at >= LEAST_LEAD_IN:
            begin, end = max(0.0, at - WINDOW_BEFORE), min(len(a) / r, at + WINDOW_AFTER)
            size = max(1, r // 100)
            window = a[int(begin * r) : int(end * r)]
            n = len(window) // size
            energy = np.sqrt(np.square(window[: n * size].astype(np.float64).reshape(n, size)).mean(axis=1)) if n else np.zeros(0)
            cut = signal.cut_point(energy, at, begin)
        else:
            before = 0
            cut = signal.judge_start(signal.levels(a, r), bool(pause))[0]
        first = int(cut * r) if cut is not None else 0
        if first <= 0 or first >= len(a):
            return a.tolist(), None, said
        return a[first:].tolist(), round(float(cut), 3), " ".join(texts[before:])

    made = {samples: "array<float>", "trimmed_bleed_s": "double", "heard": "string"}
    return _map_samples(marked, made, work, samples, rate, "_expected", "_pause", "_heard", "_starts", "_texts").drop("_expected", "_pause", "_heard", "_starts", "_texts")


def inspect_recordings(rows: DataFrame, samples: str = "samples", rate: str = "rate", transcript: str = "transcript", min_s: float = 5.0, max_s: float = 12.0) -> DataFrame:
    """All that speaks against a recording as a reference: adds duration_s, peak_dbfs, speech_ratio, chars_per_second, warnings and ok.

    Warnings are 'short', 'long', 'clipped', 'quiet', 'rate', 'pauses', 'few characters' or 'many characters', and 'abrupt', in
    this order. The pace is that of the trimmed speech. Not usable (ok false) is less than a second, or a fifth of speech."""

    def work(x: list | None, r: int | None) -> tuple:
        if x is None or not r:
            return None, None, None, None, None
        a = _array(x)
        loudest = float(np.abs(a).max(initial=0.0))
        speech = signal.trim(a, r)
        return len(a) / r, 20 * float(np.log10(loudest)) if loudest else float("-inf"), len(speech) / len(a) if len(a) else 0.0, len(speech) / r or len(a) / r, signal.ends_abruptly(a, r)

    measured = _map_samples(rows, {"duration_s": "double", "peak_dbfs": "double", "speech_ratio": "double", "_speech_s": "double", "_abrupt": "boolean"}, work, samples, rate)
    return reference_warnings(measured, rate, transcript, min_s, max_s).drop("_speech_s", "_abrupt")


def reference_warnings(measured: DataFrame, rate: str = "sample_rate", transcript: str = "transcript", min_s: float = 5.0, max_s: float = 12.0) -> DataFrame:
    """The same from measures (duration_s, peak_dbfs, speech_ratio, _speech_s, _abrupt); measures that are null warn of nothing."""
    n = F.length(strip_space(F.coalesce(F.col(transcript), F.lit(""))))
    pace = F.when((n > 0) & (F.col("_speech_s") > 0), n / F.col("_speech_s"))
    low, high = PLAUSIBLE_RATES
    warnings = F.array_compact(F.array(
        F.when(F.col("duration_s") < min_s, "short"), F.when(F.col("duration_s") > max_s, "long"), F.when(F.col("peak_dbfs") > LOUDEST, "clipped"),
        F.when(F.col("peak_dbfs") < REFERENCE_QUIETEST, "quiet"), F.when(F.col(rate) < 16000, "rate"), F.when(F.col("speech_ratio") < 0.5, "pauses"),
        F.when(pace < low, "few characters").when(pace > high, "many characters"), F.when(F.col("_abrupt"), "abrupt")))
    return measured.withColumns({"chars_per_second": pace, "warnings": warnings, "ok": ~((F.col("duration_s") < 1.0) | F.coalesce(F.col("speech_ratio") < 0.2, F.lit(False)))})


def reject_reason(text: Column, seconds: Column, peak_dbfs: Column | None = None) -> Column:
    """Why an utterance doesn't go into a data set, or null: the first rule that it breaks. A null peak isn't judged."""
    said = F.coalesce(text, F.lit(""))
    n = F.length(said)
    pace = F.when(seconds > 0, n / seconds).otherwise(0.0)
    peak = F.lit(None).cast("double") if peak_dbfs is None else peak_dbfs
    low, high = PLAUSIBLE_RATES
    return (
        F.when(said == "", "keine Rückschrift -- vermutlich kein Sprachanteil")
        .when(n < LEAST_CHARS, F.concat(F.lit("Rückschrift zu kurz -- "), said))
        .when(peak > LOUDEST, F.concat(F.lit("übersteuert -- "), F.format_string("%.1f dBFS", peak)))
        .when(peak < UTTERANCE_QUIETEST, F.concat(F.lit("zu leise -- "), F.format_string("%.1f dBFS", peak)))
        .when(~pace.between(low, high), "Text passt nicht zur Länge -- Zeichen/s")
    )


def assemble_tracks(parts: DataFrame, track: str, order: str, samples: str = "samples", rate: str = "rate", ends: str = "ends_paragraph", heading: str = "is_heading") -> DataFrame:
    """(track, rate, parts, samples): the parts that have samples in order, trimmed, faded and with pauses. Missing parts are passed
    over, a track without any has no row, and one with several rates is an error when it is computed. A track is one file, so its
    parts fit a row."""
    have = parts.where(F.col(samples).isNotNull() & F.col(track).isNotNull())
    gathered = have.groupBy(track).agg(
        F.min(rate).alias("rate"), F.max(rate).alias("_other"), F.count("*").cast("int").alias("parts"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(ends), F.lit(False)).alias("e"), F.coalesce(F.col(heading), F.lit(False)).alias("h"), F.col(samples).alias("s")))).alias("_parts"))
    same = gathered.withColumn("rate", F.when(F.col("rate") == F.col("_other"), F.col("rate")).otherwise(F.raise_error(F.concat(F.lit("parts of different rates in "), F.col(track).cast("string")))))
    work = lambda rows, r: (signal.assemble([(_array(p["s"]), p["e"], p["h"]) for p in rows], r).tolist(),)
    return _map_samples(same.drop("_other"), {"samples": "array<float>"}, work, "_parts", "rate").drop("_parts")


def cut_utterances(recordings: DataFrame, key: str = "path", samples: str = "samples", rate: str = "rate", force: bool = False) -> DataFrame:
    """(key, rate, start_s, duration_s, ok, reason, peak_dbfs, samples) of the segments of recordings; rejected ones come without samples."""

    def work(x: list | None, r: int | None) -> tuple:
        if x is None or not r:
            return ([],)
        a = _array(x)
        found = []
        for first, last, why in sorted(signal.segments(signal.levels(a, r), max(1, r // 100), len(a), r, force=force)):
            loudest = float(np.abs(a[first:last]).max(initial=0.0))
            found.append({"start_s": first / r, "duration_s": (last - first) / r, "ok": not why, "reason": why, "peak_dbfs": 20 * float(np.log10(loudest)) if loudest else float("-inf"), "samples": None if why else a[first:last].tolist()})
        return (found,)

    item = "struct<start_s:double,duration_s:double,ok:boolean,reason:string,peak_dbfs:double,samples:array<float>>"
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("duration_s", pa.float64()), ("ok", pa.bool_()), ("reason", pa.string()), ("peak_dbfs", pa.float64()), ("samples", pa.list_(pa.float32()))]))
    source = recordings.select(F.col(key).alias("k"), F.col(rate).cast("int").alias("r"), F.col(samples).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 8) for k in range(0, batch.num_rows, 8)):
                got = [work(x, r)[0] for x, r in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, kind)], ["k", "r", "found"])

    made = source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, r int, found array<{item}>")
    return made.select(F.col("k").alias(key), F.col("r").alias(rate), F.inline("found"))


def build_dataset(recordings: DataFrame, transcribe: Callable[[DataFrame], DataFrame], spoken: Callable[[Column], Column], key: str = "path", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(utterances, rejections) of recordings (path, rate, samples): segments, their transcriptions, what speaks against them, and numbers
    from 1 over all of them. ``transcribe`` adds ``heard`` to rows with samples; ``spoken`` makes the text that is trained on.

    Several rates are an error when the utterances are computed."""
    found = cut_utterances(recordings, key, force=force)
    lost = found.where("not ok").select(F.col(key).alias("source"), "start_s", "duration_s", "reason")
    heard = transcribe(found.where("ok").drop("ok", "reason")).withColumn("raw_text", strip_space(F.coalesce("heard", F.lit(""))))
    accepted, rejected = curation.number_accepted(heard, reject_reason(F.col("raw_text"), F.col("duration_s"), F.col("peak_dbfs")), [key, "start_s"])
    rates = recordings.where("samples is not null").agg(F.when(F.countDistinct("rate") > 1, F.raise_error(F.lit("recordings of different rates"))).otherwise(F.max("rate")).alias("_rate"))
    # one row: the check is joined by a constant, so that it runs with the utterances
    checked = accepted.withColumn("_one", F.lit(1)).join(rates.withColumn("_one", F.lit(1)), "_one").where("_rate is not null")
    utterances = checked.select(
        F.col("number").cast("int").alias("index"), F.concat(F.lit("wavs/utt_"), F.lpad(F.col("number").cast("string"), 5, "0"), F.lit(".wav")).alias("file"), spoken(F.col("raw_text")).alias("text"),
        "raw_text", F.round("duration_s", 3).alias("duration_s"), F.round("peak_dbfs", 1).alias("peak_dbfs"), F.col(key).alias("source"), "samples")
    return utterances, lost.unionByName(rejected.select(F.col(key).alias("source"), "start_s", "duration_s", "reason"))

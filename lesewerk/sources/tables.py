"""Reading and writing: tables, manifests (one JSON document for each folder), texts, recordings, metadata lists."""

from __future__ import annotations

import os
import shutil
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "titel string, text string, handschnitt boolean"
CHUNK = (
    "`index` int, teil int, raw_text string, normalized_text string, ends_paragraph boolean, is_heading boolean, seed bigint, lage string, status string, "
    "audio_file string, asr_text string, cer double, attempts int, engine string, error string, trimmed_bleed_s double, speaker_similarity double"
)
VARIANT = "slug string, label string, options map<string,double>, model string, lage string, project_id string, status string, median_cer double, median_similarity double, duration_s double, error string"
UTTERANCE = "`index` int, file string, text string, raw_text string, duration_s double, peak_dbfs double, source string"
#: Schemas of the manifests by file name.
MANIFESTS = {
    "project.json": f"id string, name string, created_at string, voice string, engine string, sample_rate int, source_text string, teile array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>, target_chunk_seconds double, "
    f"engine_options map<string,double>, model string, lage string, chunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>, output_file string, similarity_note string",
    "comparison.json": f"id string, name string, created_at string, voice string, engine string, text string, models array<string>, lagen array<string>, variants array<struct<{VARIANT.replace(' ', ':').replace(',:', ',')}>>",
    "dataset.json": f"name string, created_at string, sample_rate int, utterances array<struct<{UTTERANCE.replace(' ', ':').replace(',:', ',')}>>, rejected array<struct<source:string,start_s:double,duration_s:double,reason:string>>",
    "voice.json": "name string, transcript string, duration_s double, sample_rate int, chars_per_second double, lagen map<string,struct<audio_path:string,transcript:string,duration_s:double>>",
    "model.json": "name string, ckpt_path string, vocab_path string, created_at string, note string",
    "lexicon.json": "entries map<string,string>",
}
AUDIO = ("wav", "flac", "ogg", "mp3", "m4a")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_manifests(spark: SparkSession, root: str, file: str) -> DataFrame:
    """All manifests of one kind below a folder, newest first where they have a time. No inference: schemas are fixed.

    An older project with its text in one field gets that text as its only part."""
    df = spark.read.schema(MANIFESTS[file]).option("recursiveFileLookup", "true").option("pathGlobFilter", file).json(root, multiLine=True)
    if file == "project.json":
        old = F.array(F.struct(F.lit("Teil 1").alias("titel"), F.col("source_text").alias("text"), F.lit(False).alias("handschnitt")))
        df = df.withColumn("teile", F.when(F.coalesce(F.size("teile"), F.lit(0)) > 0, F.col("teile")).when(F.col("source_text").isNotNull(), old)).drop("source_text")
    return df.orderBy(F.desc("created_at"), *(["id"] if "id" in df.columns else ["name"])) if "created_at" in df.columns else df


def project_chunks(projects: DataFrame) -> DataFrame:
    """One row for each chunk of each project manifest."""
    return projects.select(F.col("id").alias("project_id"), F.inline("chunks")).withColumnRenamed("index", "chunk_index")


def project_parts(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project_id"), F.posexplode("teile").alias("teil_no", "t")).select("project_id", "teil_no", "t.*")


def source_text(parts: DataFrame) -> DataFrame:
    """The parts of each project that aren't blank, in order, joined by blank lines."""
    filled = parts.where(F.trim("text") != "")
    listed = F.sort_array(F.collect_list(F.struct("teil_no", "text")))
    return filled.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("source_text"))


def voice_recordings(voices: DataFrame) -> DataFrame:
    """(name, lage, ...) of voice manifests: the neutral recording first, then the others by name."""
    neutral = voices.select("name", F.lit("neutral").alias("lage"), "transcript", "duration_s")
    others = voices.select("name", F.explode("lagen").alias("lage", "v")).select("name", "lage", "v.transcript", "v.duration_s")
    return neutral.unionByName(others).orderBy("name", F.col("lage") != "neutral", "lage")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, spoken); a missing file is an empty lexicon."""
    if urlparse(path).scheme in ("", "file") and not os.path.exists(urlparse(path).path):
        return spark.createDataFrame([], "word string, spoken string")
    return spark.read.schema(MANIFESTS["lexicon.json"]).json(path, multiLine=True).select(F.explode("entries").alias("word", "spoken"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON documents, committed by the job as a whole."""
    df.write.mode("overwrite").json(path)


def write_metadata(utterances: DataFrame, path: str, header: bool = False, root: str = "") -> None:
    """'file|text' lists, quoted where needed; with a header and absolute paths for training."""
    file = F.concat(F.lit(root.rstrip("/") + "/"), F.col("file")) if root else F.col("file")
    utterances.select(file.alias("audio_file"), "text").write.mode("overwrite").csv(path, sep="|", header=header, escape='"', quote='"')


def guarded_delete(root: str, name: str) -> None:
    """Removes a folder directly below ``root`` and nothing else."""
    target = os.path.realpath(os.path.join(root, name))
    if os.path.dirname(target) != os.path.realpath(root):
        raise ValueError(f"not directly below {root}: {name!r}")
    shutil.rmtree(target)


# ---- recordings


def decode_wav(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(rate, channels, bits, mono float samples) of a RIFF file with PCM of 8 to 32 bits or 32-bit floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, kind, channels, rate, bits, body = 12, 1, 1, 0, 16, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", data, at + 32)[0]
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(body, dtype="<f4").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(body, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(body, dtype=f"<i{width}").astype(np.float32) / (1 << bits - 1)
    return rate, channels, bits, x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """24-bit PCM of mono samples, clipped to [-1, 1]."""
    x = np.round(np.clip(np.asarray(samples, dtype=np.float64), -1, 1) * ((1 << 23) - 1)).astype(np.int32)
    body = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 3, 3, 24, b"data", len(body))
    return head + body


def _wav_head(data: bytes) -> tuple:
    at, rate, channels, bits, frames = 12, None, None, None, None
    while at + 8 <= len(data) and frames is None:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and channels and bits:
            frames = size // (channels * bits // 8)
        at += 8 + size + size % 2
    return rate, channels, bits, frames


def _flac_head(data: bytes) -> tuple:
    packed = int.from_bytes(data[18:26], "big")  # of the stream's first block
    return packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1 or None


def _ogg_head(data: bytes) -> tuple:
    kind = data.find(b"\x01vorbis", 0, 200)
    if kind >= 0:
        channels, rate = data[kind + 11], struct.unpack_from("<I", data, kind + 12)[0]
    elif (kind := data.find(b"OpusHead", 0, 200)) >= 0:
        channels, rate = data[kind + 9], 48000
    else:
        return None, None, None, None
    last = data.rfind(b"OggS")
    return rate, channels, None, struct.unpack_from("<q", data, last + 6)[0]


#: MPEG audio, version 1 and 2 of layer III: bit rates in kbit/s and sample rates, by their index.
_MPEG_BITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MPEG_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000)}


def _mp3_head(data: bytes) -> tuple:
    at = 0
    if data[:3] == b"ID3" and len(data) > 9:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    while at + 4 <= len(data) and not (data[at] == 0xFF and data[at + 1] & 0xE6 == 0xE2):
        at += 1
    if at + 4 > len(data):
        return None, None, None, None
    version = 1 if data[at + 1] & 8 else 2
    bits, place = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if not 0 < bits < 15 or place > 2:
        return None, None, None, None
    rate, channels = _MPEG_RATES[version][place], 1 if data[at + 3] >> 6 == 3 else 2
    tag = at + 4 + (17 if channels == 1 else 32) // (1 if version == 1 else 2) + (version == 2 and channels == 2)
    if data[tag : tag + 4] in (b"Xing", b"Info") and data[tag + 7] & 1:  # the number of frames is written down
        return rate, channels, None, int.from_bytes(data[tag + 8 : tag + 12], "big") * (1152 if version == 1 else 576)
    return rate, channels, None, int((len(data) - at) * 8 / (_MPEG_BITS[version][bits] * 1000) * rate)


def _m4a_head(data: bytes) -> tuple:
    at = data.find(b"mdhd")
    if at < 0:
        return None, None, None, None
    long = data[at + 4] == 1
    rate, length = struct.unpack_from(">IQ" if long else ">II", data, at + (24 if long else 16))
    return rate, None, None, length


_HEADS = {b"RIFF": _wav_head, b"fLaC": _flac_head, b"OggS": _ogg_head}


def recording_head(data: bytes) -> tuple[int | None, int | None, int | None, float | None]:
    """(rate, channels, bits, seconds) from the headers of a WAV, FLAC, Ogg, MP3 or M4A file; nothing is decoded. Nulls for what the header
    doesn't say or what isn't a recording."""
    read = _HEADS.get(bytes(data[:4])) or (_m4a_head if data[4:8] == b"ftyp" else _mp3_head)
    try:
        rate, channels, bits, frames = read(data)
    except (IndexError, struct.error):
        return None, None, None, None
    return rate, channels, bits, frames / rate if rate and frames is not None else None


def describe_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, rate, channels, bits, seconds) of the recordings of a folder, by the suffixes of ``AUDIO``, sorted by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(AUDIO) + "}").load(path).select("path", "length", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, *recording_head(data)) for p, n, data in zip(batch["path"], batch["length"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "bytes", "rate", "channels", "bits", "seconds"]).astype({"rate": "Int32", "channels": "Int32", "bits": "Int32"})

    return files.mapInPandas(run, "path string, bytes bigint, rate int, channels int, bits int, seconds double").orderBy("path")


def read_recordings(spark: SparkSession, path: str, levels_only: bool = True) -> DataFrame:
    """(path, rate, channels, seconds, peak_dbfs, levels or samples) of the WAV files of a folder, decoded in Arrow batches."""
    from lesewerk.operators.signal import levels

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    series = "levels" if levels_only else "samples"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rate, channels, _, x = decode_wav(data)
                peak = float(np.abs(x).max()) if len(x) else 0.0
                rows.append((name, rate, channels, len(x) / rate if rate else 0.0, 20 * np.log10(peak) if peak else None, levels(x, rate) if levels_only else x))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "seconds", "peak_dbfs", series])

    return files.mapInPandas(run, f"path string, rate int, channels int, seconds double, peak_dbfs double, {series} array<{'double' if levels_only else 'float'}>")

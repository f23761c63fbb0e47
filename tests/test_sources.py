import json
import os

import numpy as np
import pytest

from lesewerk.sources import tables as t


def test_manifests(spark, tmp_path):
    for name, created, body in (("a", "2024-01-01", {"teile": [{"titel": "T", "text": "x", "handschnitt": False}, {"titel": "", "text": " ", "handschnitt": False}], "chunks": [{"index": 0, "raw_text": "r", "cer": None}]}), ("b", "2024-02-01", {"source_text": "alt"})):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "project.json").write_text(json.dumps({"id": name, "created_at": created, "engine_options": {"speed": 1.0}, **body}))
    (tmp_path / "a" / "other.json").write_text("{}")
    p = t.read_manifests(spark, str(tmp_path), "project.json")
    assert [r.id for r in p.collect()] == ["b", "a"]
    assert {(r.project_id, r.text) for r in t.source_text(t.project_parts(p)).select("project_id", t.F.col("source_text").alias("text")).collect()} == {("a", "x"), ("b", "alt")}
    assert [(r.project_id, r.chunk_index) for r in t.project_chunks(p).collect()] == [("a", 0)]


def test_metadata_and_lexicon(spark, tmp_path):
    u = spark.createDataFrame([("wavs/1.wav", 'Er sagte "ja|nein"'), ("wavs/2.wav", "x")], "file string, text string")
    t.write_metadata(u.coalesce(1), str(tmp_path / "m"))
    lines = [x for f in os.listdir(tmp_path / "m") if f.endswith(".csv") for x in (tmp_path / "m" / f).read_text().splitlines()]
    assert sorted(lines) == ['wavs/1.wav|"Er sagte ""ja|nein"""', "wavs/2.wav|x"]
    t.write_metadata(u.coalesce(1), str(tmp_path / "h"), header=True, root="/daten")
    assert spark.read.csv(str(tmp_path / "h"), sep="|", header=True).columns == ["audio_file", "text"]
    assert t.read_lexicon(spark, str(tmp_path / "fehlt.json")).count() == 0
    (tmp_path / "l.json").write_text('{"entries": {"MP3": "Em-Pe-3"}}')
    assert [tuple(r) for r in t.read_lexicon(spark, str(tmp_path / "l.json")).collect()] == [("MP3", "Em-Pe-3")]


def test_recordings(spark, tmp_path):
    x = np.sin(np.arange(24000) / 20).astype(np.float32) * 0.5
    (tmp_path / "a.wav").write_bytes(t.encode_wav(x, 24000))
    (tmp_path / "b.txt").write_text("kein Ton")
    rate, channels, bits, y = t.decode_wav(t.encode_wav(x, 24000))
    assert (rate, channels, bits) == (24000, 1, 24) and np.abs(x - y).max() < 1e-6
    r = t.read_recordings(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].seconds == 1.0 and len(r[0].levels) == 100
    with pytest.raises(ValueError):
        t.decode_wav(b"nichts")


def test_guarded_delete(tmp_path):
    os.makedirs(tmp_path / "store" / "x")
    t.guarded_delete(str(tmp_path / "store"), "x")
    assert not (tmp_path / "store" / "x").exists()
    with pytest.raises(ValueError):
        t.guarded_delete(str(tmp_path / "store"), "../..")


def test_streams(spark, tmp_path, sf_dir):
    from lesewerk.streaming import progress

    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    progress.run_once(progress.state_counts(stream, "3650 days"), "counts", str(tmp_path / "cp"))
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == chunks.where("saved_at is not null").count()


def test_heads_of_recordings(spark, tmp_path):
    import struct

    from lesewerk.sources import tables as t

    flac = b"fLaC" + b"\x80\x00\x00\x22" + bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + bytes(16)
    ogg = b"OggS" + bytes(2) + struct.pack("<q", 0) + bytes(14) + b"\x01vorbis" + bytes(4) + b"\x02" + struct.pack("<I", 22050) + b"OggS" + bytes(2) + struct.pack("<q", 44100) + bytes(12)
    mp3 = b"\xff\xfb\x90\x00" + bytes(15996)  # 128 kbit/s, 44.1 kHz, stereo
    m4a = bytes(4) + b"ftypM4A " + b"mdhd" + bytes(4) + bytes(8) + struct.pack(">II", 48000, 96000)
    wav = t.encode_wav(np.zeros(12000), 24000)
    for name, data in (("a.flac", flac), ("b.ogg", ogg), ("c.mp3", mp3), ("d.m4a", m4a), ("e.wav", wav), ("f.wav", b"RIFF"), ("g.mp3", b"\0"), ("note.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = [(r.rate, r.channels, r.seconds) for r in t.describe_recordings(spark, str(tmp_path)).collect()]
    assert got == [(44100, 2, 2.0), (22050, 2, 2.0), (44100, 2, pytest.approx(1.0, abs=0.01)), (48000, None, 2.0), (24000, 1, 0.5), (None, None, None), (None, None, None)]


def test_spectrum_embedding(spark):
    from lesewerk.sources import models

    tone = lambda f: np.sin(2 * np.pi * f * np.arange(2400) / 24000).astype(float).tolist()
    df = spark.createDataFrame([(1, tone(200)), (2, tone(200)), (3, tone(5000)), (4, []), (5, None)], "id int, samples array<double>")
    got = {r.id: r.vector for r in models.apply_model(df, "spectrum-embedding", "id int, vector array<double>").collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 64 and set(got[4]) == {0.0} and got[5] is None

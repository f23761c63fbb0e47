import numpy as np
import pytest
from pyspark.sql import functions as F

from lesewerk.functions import columns as c
from lesewerk.operators import curation, editing, signal
from lesewerk.sources import models

SCHEMA = "project_id string, chunk_index int, raw_text string, normalized_text string, ends_paragraph boolean, is_heading boolean, seed bigint, status string, audio_file string"


def sequence(spark, project="p", texts=("Titel", "Eins.", "Zwei", "Drei.")):
    return spark.createDataFrame([(project, i, t, t.lower(), i in (0, 3), i == 0, i * 10, "ok", f"{i}.wav") for i, t in enumerate(texts)], SCHEMA)


def shown(df):
    return [(r.raw_text, r.ends_paragraph, r.audio_file) for r in df.orderBy("project_id", "chunk_index").collect()]


def test_insert(spark):
    df = sequence(spark)
    new = spark.createDataFrame([("p", 1, False, " Neu. "), ("p", 3, True, "Schluss."), ("p", 9, False, "x"), ("p", 2, True, "  ")], "project_id string, chunk_index int, after boolean, raw_text string")
    out = editing.insert_chunks(df, new)
    assert shown(out) == [("Titel", True, "0.wav"), ("Neu.", False, None), ("Eins.", False, "1.wav"), ("Zwei", False, "2.wav"), ("Drei.", False, "3.wav"), ("Schluss.", True, None)]
    assert [r.chunk_index for r in out.orderBy("chunk_index").collect()] == list(range(6))
    assert out.where("raw_text = 'Neu.'").first().seed == df.limit(1).select(c.derive_seed(F.lit("p"), F.lit(1), F.lit(0))).first()[0]


def test_merge(spark):
    df = sequence(spark).union(sequence(spark, "q"))
    out = editing.merge_chunks(df, spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 7)], "project_id string, chunk_index int"))
    assert shown(out) == [("Titel", True, "0.wav"), ("Eins. Zwei", False, None), ("Drei.", True, "3.wav"), ("Titel", True, "0.wav"), ("Eins.", False, "1.wav"), ("Zwei. Drei.", True, None)]
    assert out.where("audio_file is null").select("status").distinct().collect() == [("pending",)]


def test_curation(spark):
    s = spark.createDataFrame([("b", 1, 4.0, "gut"), ("a", 2, 6.0, "auch gut"), ("a", 1, 5.0, ""), ("b", 0, 2.0, "x")], "source string, k int, seconds double, text string")
    good, bad = curation.number_accepted(s, F.when(F.col("text") == "", "leer"), ["source", "k"])
    assert [(r.source, r.k, r.number) for r in good.orderBy("number").collect()] == [("a", 2, 1), ("b", 0, 2), ("b", 1, 3)] and bad.count() == 1
    f = {r.source: r for r in curation.dataset_figures(good, bad, ["source"], "seconds", F.length("text")).collect()}
    assert f["b"].segments == 2 and f["b"].median_s == 3 and f["b"].rejected == 0 and f["a"].rejected == 1
    whole = curation.dataset_figures(good, bad, [], "seconds", F.length("text")).first()
    assert (whole.segments, whole.rejected) == (3, 1)
    probe = spark.createDataFrame([("r", -60.0, False, 3, True), ("r", -50.0, True, 1, True), ("r", -40.0, False, 3, True), ("h", -50.0, True, 0, False)], "k string, threshold_db double, used boolean, pauses_split bigint, usable boolean")
    got = {r.k: r for r in curation.probe_summary(probe, "k", spark.createDataFrame([("r", 40.0), ("h", 10.0)], "k string, seconds double")).collect()}
    assert (got["r"].best_db, got["r"].needed, got["r"].enough) == (-60.0, 2, False) and got["h"].hopeless and got["h"].enough
    files = spark.createDataFrame([("m", n) for n in ("a/model_100.pt", "a/vocab.txt", "b/model_last.safetensors", "b/c/vocab.txt", "vocab.txt", "b/bigvgan_9.safetensors", "b/vocab.txt")], "m string, name string")
    assert tuple(curation.model_files(files, "m").first()) == ("m", "b/model_last.safetensors", "b/vocab.txt")
    order = spark.createDataFrame([(n,) for n in ("model_5.pt", "model_last.pt", "model_x.pt", "model_50.pt", "other.pt")], "name string")
    assert [r.name for r in curation.checkpoint_order(order).collect()] == ["model_last.pt", "model_50.pt", "model_5.pt", "model_x.pt"]
    stale = curation.stale_outputs(spark.createDataFrame([("p", 5), ("q", 1)], "p string, modified int"), spark.createDataFrame([("p", 3), ("q", 3), ("r", None)], "p string, modified int"), ["p"])
    assert {(r.p, r.stale) for r in stale.collect()} == {("p", True), ("q", False), ("r", False)}


def test_models(spark):
    rows = spark.createDataFrame([(1, "eins zwei drei", 4), (2, "vier", 3), (3, None, 2)], "id int, text string, seed int")
    assert {r.id: r.heard for r in models.apply_model(rows, "echo", "id int, heard string", corrupt=2).collect()} == {1: "zwei", 2: "vier", 3: None}
    v = {r.id: r.vector for r in models.apply_model(rows, "hash-embedding", "id int, vector array<double>", size=8).collect()}
    assert len(v[1]) == 8 and v[1] != v[2] and v[3] is None
    with pytest.raises(KeyError):
        models.apply_model(rows, "fehlt", "id int")


def test_more_columns(spark):
    df = spark.createDataFrame([("Ja, gut", "2024-01-08 06:26:41"), ("Sie kam", None), ("", None)], "t string, at string")
    assert [r[0] for r in df.select(c.expects_pause("t")).collect()] == [True, False, False]
    assert df.select(c.make_id("t", F.col("at").cast("timestamp"))).first()[0] == "20240108-062641-ja-gut"
    n = spark.createDataFrame([("1, 2 x 2,3.5",)], "t string").select(c.number_list("t")).first()[0]
    assert n == [1.0, 2.0, 3.5]
    d = spark.createDataFrame([("Kapitel eins.", "x" * 170, 10.0, 1.0), ("y" * 81, "x", 10.0, 1.0), ("Langer Text", "x", 10.0, 1.0), ("a", "", 10.0, 1.0)], "t string, r string, s double, v double").select(c.fixed_duration("t", "r", "s", "v").alias("d")).collect()
    assert round(d[0].d, 3) == round(10 + 13 / 14 + 0.5, 3) and [x.d for x in d[1:]] == [None, None, None]
    o = spark.createDataFrame([("x" * 15, 1.0), ("x", None)], "t string, s double")
    assert [r[0] for r in o.select(c.over_length("t", "s")).collect()] == [True, False] and not o.select(c.over_length("t", None)).first()[0]


def test_track_and_ends():
    tone = np.sin(np.arange(24000) / 10).astype(np.float32) * 0.5
    assert signal.ends_abruptly(tone, 24000) and not signal.ends_abruptly(np.concatenate([tone, np.zeros(9000)]), 24000) and not signal.ends_abruptly(tone[:100], 24000)
    track = signal.assemble([(tone, False, True), (tone, True, False), (tone, False, False)], 24000)
    assert len(track) == 3 * 24000 + int(1.2 * 24000) + int(0.8 * 24000) and len(signal.assemble([], 24000)) == 0

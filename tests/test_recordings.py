import numpy as np
import pytest
from pyspark.sql import functions as F

from lesewerk.operators import recordings as r

RATE = 8000


def tone(seconds, amp=0.4):
    return (np.sin(2 * np.pi * 200 * np.arange(int(seconds * RATE)) / RATE) * amp).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def rows(spark):
    silent = [0.0] * RATE
    return spark.createDataFrame([(1, RATE, silent + tone(1.0) + silent, "x"), (2, RATE, [], "y"), (3, RATE, None, "z"), (4, None, tone(0.1), "w"), (5, RATE, silent, "v")], "k int, rate int, samples array<float>, note string")


def test_trim_fade_resample(rows):
    trimmed = {x.k: x.samples for x in r.trim_recordings(rows).collect()}
    assert abs(len(trimmed[1]) / RATE - 1.08) < 0.03 and trimmed[2] == [] and trimmed[3] is None and trimmed[4] is None and trimmed[5] == []
    faded = {x.k: x for x in r.fade_recordings(r.trim_recordings(rows)).collect()}
    assert faded[1].samples[0] == 0 and faded[1].note == "x"
    half = {x.k: x for x in r.resample_recordings(rows, RATE // 2).collect()}
    assert len(half[1].samples) == 3 * RATE // 2 and half[1].rate == RATE // 2 and half[3].samples is None
    levels = {x.k: x.levels for x in r.frame_levels(rows).collect()}
    assert len(levels[1]) == 300 and levels[2] == [] and levels[3] is None


def test_inspection(rows):
    got = {x.k: x for x in r.inspect_recordings(rows.withColumn("transcript", F.lit(None).cast("string"))).collect()}
    assert got[1].ok and "pauses" in got[1].warnings and got[3].duration_s is None and not got[2].ok and not got[5].ok


def test_tracks(spark, rows):
    parts = rows.withColumn("track", F.lit("t")).withColumn("ends_paragraph", F.lit(False)).withColumn("is_heading", F.lit(False)).where("rate is not null")
    got = r.assemble_tracks(parts, "track", "k").first()
    assert got.parts == 3 and got.rate == RATE and abs(len(got.samples) / RATE - (1.08 + 2 * 0.35)) < 0.05
    mixed = parts.withColumn("rate", F.when(F.col("k") == 1, 1).otherwise(F.col("rate")))
    with pytest.raises(Exception, match="different rates"):
        r.assemble_tracks(mixed, "track", "k").collect()
    assert r.assemble_tracks(parts.where("samples is null"), "track", "k").count() == 0


def test_dataset_of_mixed_rates_fails(spark):
    x = spark.createDataFrame([("a", RATE, tone(5.0) + [0.0] * RATE + tone(5.0)), ("b", RATE * 2, tone(5.0))], "path string, rate int, samples array<float>")
    good, _ = r.build_dataset(x, lambda d: d.withColumn("heard", F.lit("Ein Satz mit Text, der passt, und noch ein wenig mehr davon.")), lambda c: c)
    with pytest.raises(Exception, match="different rates"):
        good.collect()


@pytest.mark.parametrize("text, seconds, peak, begin", [
    ("", 5.0, -3.0, "keine"), (None, 5.0, -3.0, "keine"), ("abc", 5.0, -3.0, "Rückschrift"), ("x" * 60, 5.0, 0.0, "übersteuert"), ("x" * 60, 5.0, -40.0, "zu leise"), ("x" * 20, 5.0, -3.0, "Text"),
    ("x" * 60, 0.0, -3.0, "Text"), ("x" * 60, 5.0, -3.0, None), ("x" * 60, 5.0, None, None),
])
def test_first_rule_counts(spark, text, seconds, peak, begin):
    why = spark.createDataFrame([(text, seconds, peak)], "t string, s double, p double").select(r.reject_reason(F.col("t"), F.col("s"), F.col("p")).alias("r")).first().r
    assert why is None if begin is None else why.startswith(begin)

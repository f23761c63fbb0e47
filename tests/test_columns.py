import math

import pytest
from pyspark.sql import functions as F

from lesewerk.functions import columns as c
from lesewerk.functions import metrics


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_text_columns(spark):
    assert one(spark, [("„A“ – B … ‚c‘",), (None,), ("",)], "t string", c.clean_typography("t")) == ["\"A\", B . 'c'", None, ""]
    assert one(spark, [(" a  b , c\n\n\n\nd ",)], "t string", c.collapse_space("t")) == ["a b, c\n\nd"]
    assert one(spark, [("Über: Größe_1!",)], "t string", c.comparison_form("t")) == ["ueber groesse_1"]
    assert one(spark, [("USB 3",), ("ß",)], "t string", c.spell_out("t")) == ["U-Es-Be-Drei", "Es-Es"]
    assert one(spark, [("Der NDR und die ARD, der NDR; ÜBER A 1A GmbH B2",)], "t string", c.acronyms("t")) == [["NDR", "ARD", "ÜBER"]]
    assert one(spark, [("Ein Name!",), ("!!",)], "t string", c.slug("t")) == ["ein-name", "variante"]
    assert one(spark, [("a [lacht] b [PAUSE] c",)], "t string", c.strip_tags("t", ["pause"])) == ["a b [PAUSE] c"]


@pytest.mark.parametrize("left, right, expected", [("Titel", "Text.", "Titel. Text."), ("Satz.", "Noch", "Satz. Noch"), ("er sagte,", "dann", "er sagte, dann"), ("„Halt!“", "x", "„Halt!“ x"), ("", "x", "x"), ("x", " ", "x"), ('"a"', "b", '"a". b')])
def test_join_raw(spark, left, right, expected):
    assert one(spark, [(left, right)], "l string, r string", c.join_raw("l", "r")) == [expected]


@pytest.mark.parametrize("line, following, expected", [("Kapitel 1", "Es war", "Kapitel 1"), ("Ein Satz.", "", None), ("# Titel #", "klein", "Titel"), ("klein", "", None), ("Der lange Weg", "geht weiter", None), ("x" * 71, "", None), ("", "", None), ("A", ", b", None)])
def test_heading(spark, line, following, expected):
    from lesewerk.operators.segment import heading

    assert one(spark, [(line, following)], "l string, n string", c.heading_text("l", "n")) == [expected]
    assert heading(line, following) == expected


def test_numbers(spark):
    assert one(spark, [(48.4,), (372.0,), (3870.0,)], "s double", c.duration_text("s")) == ["48 s", "6:12 min", "1:04:30 h"]
    assert one(spark, [(14.0,), (14.5,), (15.0,), (None,), (29.0,), (100.0,), (10.0,)], "r double", c.suggested_speed("r")) == [None, None, None, None, 0.5, 0.5, 1.45]
    got = one(spark, [(6.0, 20.0), (9.0, 20.0), (12.0, 20.0), (30.0, 20.0), (2.0, 8.0)], "r double, t double", c.chunk_budget("t", F.lit(22.0), "r"))
    assert got == [16, 13, 10, 10, 8]
    assert one(spark, [("p", 3, 1)], "p string, i int, a int", c.derive_seed("p", "i", "a")) == [int.from_bytes(__import__("hashlib").sha1(b"p:3:1").digest()[:4], "big") % (2**31 - 1)]
    plan = one(spark, [(3720.0,)], "s double", c.training_plan("s", F.lit(100)))[0]
    assert (plan.steps_per_epoch, plan.total_steps, plan.warmup_steps, plan.save_every) == (218, 21800, 200, 1000)
    assert one(spark, [("2024-01-08T06:26:41+00:00",), ("kein Datum",), ("2024-01-08T06:26:41Z",)], "t string", c.moment_text("t")) == ["08.01.2024, 06:26", "kein Datum", "08.01.2024, 06:26"]


@pytest.mark.parametrize("ref, hyp, cer, wer", [("Hallo Welt", "hallo, welt!", 0, 0), ("", "", 0, 0), ("", "x", 1, 1), ("ab", "abcdef", 2, 1), ("über", "ueber", 0, 0), ("über", "über", 0, 0), ("eins zwei drei", "eins drei", 5 / 14, 1 / 3)])
def test_error_rates(spark, ref, hyp, cer, wer):
    r = metrics.with_error_rates(spark.createDataFrame([(ref, hyp)], "r string, h string"), "r", "h").first()
    assert math.isclose(r.cer, cer) and math.isclose(r.wer, wer)


def test_error_rates_of_null(spark):
    r = metrics.with_error_rates(spark.createDataFrame([(None, "x")], "r string, h string"), "r", "h").first()
    assert r.cer is None and r.wer is None


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])]
    assert one(spark, rows, "a array<double>, b array<double>", metrics.cosine("a", "b")) == [1, 0, 0, 0, 0, 0]

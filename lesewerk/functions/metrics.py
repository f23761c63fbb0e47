"""Distances between what was written and what was heard, and between vectors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesewerk.functions.columns import col, comparison_form


#: Characters that composition may change, and some that it never does: few ranges, as every text is searched for them.
_LOOSE = r"[\x{300}-\x{2001}\x{20d0}-\x{20ff}\x{2126}-\x{212b}\x{2329}\x{232a}\x{2adc}\x{2cef}-\x{2dff}\x{302a}-\x{309a}\x{a66f}-\x{abff}\x{d7b0}-\x{10ffff}]"


def composed(c: Column | str) -> Column:
    """NFC. Spark has no function for it: texts that composition can change go to Python, of all others a null does."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(nfc(F.when(F.rlike(col(c), F.lit(_LOOSE)), col(c))), col(c))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two comparison forms by the length of the first; 0 or 1 where that is empty. May exceed 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


def cer(reference: Column | str, hypothesis: Column | str) -> Column:
    return char_error_rate(comparison_form(composed(reference)), comparison_form(composed(hypothesis)))


def _symbols(places: Column) -> Column:
    """Numbers as one character each, from U+0100 on, beyond the surrogates where need be."""
    point = lambda p: p + F.when(p < 0xD700, 255).otherwise(0x8FF)
    return F.array_join(F.transform(places, lambda p: F.decode(F.unhex(F.lpad(F.hex(point(p)), 8, "0")), "UTF-32")), "")


def with_error_rates(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds ``cer`` and ``wer`` of two texts; null where one of them is null.

    By words each distinct word of a pair becomes a character, so that the built-in distance takes it. Every step is a column of its own:
    inside a lambda an expression would be made again for each word."""
    words = lambda form: F.filter(F.split(form, " "), lambda w: w != "")
    out = rows.withColumns({"_a": comparison_form(composed(reference)), "_b": comparison_form(composed(hypothesis))})
    out = out.withColumns({"_x": words(F.col("_a")), "_y": words(F.col("_b"))}).withColumn("_every", F.array_distinct(F.concat("_x", "_y")))
    place = lambda w: F.array_position("_every", w)
    out = out.withColumns({"_p": F.transform("_x", place), "_q": F.transform("_y", place)})
    by_words = F.when(F.size("_x") == 0, F.when(F.size("_y") == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(_symbols(F.col("_p")), _symbols(F.col("_q"))) / F.size("_x"))
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = out.withColumns({"cer": F.when(known, char_error_rate(F.col("_a"), F.col("_b"))), "wer": F.when(known, by_words)})
    return out.drop("_a", "_b", "_x", "_y", "_every", "_p", "_q")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 for empty ones, different lengths, nulls and zero vectors."""
    x, y = (F.transform(col(c), lambda v: v.cast("double")) for c in (a, b))
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), add)) * F.sqrt(F.aggregate(F.transform(y, lambda v: v * v), F.lit(0.0), add))
    same = F.coalesce((F.size(x) == F.size(y)) & (F.size(x) > 0), F.lit(False))
    return F.when(same & (norm > 0), dot / norm).otherwise(0.0)

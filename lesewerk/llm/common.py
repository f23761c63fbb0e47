"""Shared parts of the operators: tables, current rows, checked driver-side data."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public tokenizer files; every operator takes another path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_texts(df: DataFrame, key: str, text: str, flag: str | None = None) -> DataFrame:
    """One row for each (key, text): the texts of one key's rows never differ, so duplicate rows fall together.

    Grouping by plain columns keeps the hash aggregate; a ``first`` or ``max_by`` over texts would sort them all.
    """
    if flag is None:
        return df.select(key, text).distinct()
    return df.groupBy(key, text).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias(flag))


def items(teile: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both kinds of text as (item_kind, item_id, engine, is_heading, text), duplicate rows once; null ids and texts are left out."""
    t = distinct_texts(teile.where("text is not null and teil_id is not null"), "teil_id", "text")
    c = distinct_texts(chunks.where("raw_text is not null and chunk_id is not null"), "chunk_id", "raw_text", "is_heading")
    return t.select(F.lit("teil").alias("item_kind"), F.col("teil_id").cast("bigint").alias("item_id"), F.lit(False).alias("is_heading"), "text").unionByName(
        c.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").cast("bigint").alias("item_id"), "is_heading", F.col("raw_text").alias("text"))
    )


def latest(df: DataFrame, key: str, *values: str, by: str = "saved_at") -> DataFrame:
    """The current state of each key: the values of the row with the latest ``by`` (null counts as oldest).

    Among rows of the same time the greatest value struct is taken, so the result doesn't depend on the order of rows.
    """
    when = F.coalesce(F.col(by).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    best = F.max(F.struct(when.alias("at"), *[F.col(v) for v in values])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{v}").alias(v) for v in values])


def small_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows for the driver of a table that must stay small; its size is checked, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def fold_name(c: Column) -> Column:
    """One spelling of a name: trimmed, lower case; empty as null."""
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def fold_lang(c: Column) -> Column:
    """Primary subtag in lower case ('de-DE', 'DE' -> 'de'); null, empty and 'und' -> 'und'."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit("")), F.lit("und"))

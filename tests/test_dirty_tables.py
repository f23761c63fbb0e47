"""Every query on empty tables, and on tables whose rows hold nothing but nulls: none fails."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls"):
        root = tmp_path_factory.mktemp(kind)
        for f in os.listdir(sf_dir):
            df = spark.read.parquet(f"{sf_dir}/{f}")
            rows = df.limit(0) if kind == "empty" else df.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
            rows.coalesce(1).write.parquet(f"{root}/{f}")
        out[kind] = str(root)
    return out


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_failure(spark, folders, kind, name):
    QUERIES[name](spark, folders[kind]).collect()

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lesewerk.llm import percentiles as p

TARGETS = {"low": 0.0, "p25": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


def rows(n=3000):
    random.seed(7)
    out = [("hot" if random.random() < 0.4 else random.choice("abc"), random.randint(0, 9), random.choice([random.gauss(0, 3), 0.5, round(random.random(), 2)])) for _ in range(n)]
    return out + [("a", 1, None), ("a", 1, float("nan")), ("none", 1, None), (None, 1, 2.5), ("one", 1, -0.0), ("inf", 1, float("inf")), ("wide", 1, 1e6), ("wide", 1, -1e6)]


def exact(data):
    by = collections.defaultdict(list)
    for g, _, v in data:
        if v is not None and math.isfinite(v):
            by[g].append(v)
    return {g: {t: float(np.quantile(v, q)) for t, q in TARGETS.items()} | {"n": len(v)} for g, v in by.items()}


def found(df, **kw):
    return {r.g: r.asDict() for r in p.percentiles(df, ["g"], TARGETS, **kw).collect()}


def test_exact_and_bounded(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "g string, day int, v double, n int")
    want = exact(data)
    value = p.measured(F.col("v"))
    for resolution in (None, 0.01):
        got = found(p.partial_counts(df, ["g"], value, resolution), resolution=resolution)
        assert set(got) == set(want)
        for g, w in want.items():
            assert got[g]["n"] == w["n"]
            assert all(abs(got[g][t] - w[t]) <= got[g]["error_bound"] + 1e-9 for t in TARGETS)
    assert found(p.partial_counts(df.limit(0), ["g"], value)) == {}


def test_partial_results_combine(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, day int, v double")
    value = p.measured(F.col("v"))
    days = [p.partial_counts(df.where(F.col("day") == d), ["g", "day"], value) for d in range(10)]
    assert found(p.combine(days, ["g"])) == found(p.partial_counts(df, ["g"], value))


def test_without_groups(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    r = p.percentiles(p.partial_counts(df, [], "v", cells=2), [], {"m": 0.5, "q": 0.33}).first()
    assert r.n == 11 and r.m == 5.0 and abs(r.q - 3.3) < 1e-9


def test_measured(spark):
    df = spark.createDataFrame([(x,) for x in (None, float("nan"), -1.0, 0.0, 2.0, float("-inf"))], "v double")
    assert [r[0] for r in df.select(p.measured(F.col("v"), low=0.0, high=1.0)).collect()] == [None, None, None, 0.0, None, None]


def test_found_by_brute_force(spark, tmp_path):
    from lesewerk.llm.queries import p5_found

    chunks = [(1, "p", 0.2, "2024-01-01"), (1, "p", None, "2023-01-01"), (2, "p", 0.4, "2024-01-01"), (2, "p", 0.4, "2024-01-01"), (3, "p", -1.0, None), (4, "p", float("nan"), None), (5, "q", None, None)]
    variants = [(1, "p", "done", 0.3), (2, "p", "done", 0.32), (3, "p", "failed", 0.9), (4, "q", "done", 0.1), (5, "q", "done", None), (6, "p", "done", 0.31), (7, "r", "done", 0.0), (1, "p", "done", 0.3)]
    spark.createDataFrame(chunks, "chunk_id bigint, project_id string, cer double, saved_at string").withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz")).write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame(variants, "variant_id bigint, project_id string, status string, median_cer double").write.parquet(str(tmp_path / "variants.parquet"))
    assert sorted(r.variant_id for r in p5_found(spark, str(tmp_path)).collect()) == [2, 4, 7]


def test_ranges_rise_with_the_value(spark):
    import random

    random.seed(1)
    values = [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, -1.0] + [random.choice((1, -1)) * 10 ** random.uniform(-300, 300) for _ in range(500)] + [random.random() for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", p.range_of(F.col("v")).alias("r")).orderBy("v").collect()
    assert all(a.r <= b.r for a, b in zip(rows, rows[1:]))
    assert {r.v: r.r for r in rows}[0.0] == 0


def test_nine_orders_of_magnitude_and_a_hot_range(spark):
    """Values of many magnitudes and many values close together: exact, with few distinct values in any range."""
    random.seed(2)
    data = [("wide", 10 ** random.uniform(-3, 6)) for _ in range(4000)] + [("hot", 0.1 + random.random() / 50) for _ in range(4000)] + [("bytes", float(random.randrange(10**9, 10**12))) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, v double")
    partial = p.partial_counts(df, ["g"], "v")
    got = {r.g: r for r in p.percentiles(partial, ["g"], TARGETS).collect()}
    for g in ("wide", "hot", "bytes"):
        of = [v for h, v in data if h == g]
        for t, q in TARGETS.items():
            assert math.isclose(got[g][t], np.quantile(of, q), rel_tol=1e-12)
    assert max(r.n for r in partial.groupBy("g", "range_no").agg(F.count("*").alias("n")).collect()) < 40

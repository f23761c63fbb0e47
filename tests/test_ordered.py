import random

from pyspark.sql import functions as F

from lesewerk.operators import ordered, tables


def test_running_sum(spark):
    random.seed(1)
    rows = [(random.choice(["a", "b", None]), i, random.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r.s for r in ordered.running_sum(df, ["k"], "i", "v", "s", stretch=7).collect()}
    for k, i, _ in rows:
        assert got[i] == sum(v for q, j, v in rows if q == k and j < i)


def test_runs_and_pauses(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([("r", i, bool(f)) for i, f in enumerate(flags)] + [("q", 0, None)], "k string, i int, f boolean")
    got = sorted((r.start, r.end, r.frames) for r in ordered.runs(df, ["k"], "i", F.col("f"), gap=2).collect())
    assert got == [(1, 5, 3), (8, 9, 1)]
    quiet = {r.k: (r.pauses, r.longest) for r in ordered.inner_runs(df, ["k"], "i", ~F.col("f"), 1).collect()}
    assert quiet == {"r": (2, 3), "q": (0, 0)}
    gaps = [r.gap for r in ordered.neighbour_gaps(ordered.runs(df, ["k"], "i", F.col("f")), ["k"]).orderBy("start").collect()]
    assert gaps == [1, 1, 3]


def test_timeline_and_paragraphs(spark):
    rows = [("p", 0, "Titel", 1.0, True, True), ("p", 1, "Eins.", 2.0, False, False), ("p", 2, "Zwei.", 2.0, False, True), ("p", 3, "Drei.", 1.0, False, False)]
    df = spark.createDataFrame(rows, "k string, i int, t string, s double, h boolean, e boolean")
    got = [(r.start_s, r.pause_s) for r in ordered.timeline(df, ["k"], "i", "s", "h", "e").orderBy("i").collect()]
    assert got == [(0.0, 1.2), (2.2, 0.35), (4.55, 0.8), (7.35, 0.0)]
    assert ordered.paragraphs(df, ["k"], "i", "t", "e").first().t == "Titel\n\nEins. Zwei.\n\nDrei."


def test_match_texts_is_first_in_first_out(spark):
    old = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("p", 2, "a")], "k string, i int, t string")
    new = spark.createDataFrame([("p", 5, "a"), ("p", 6, "c"), ("p", 7, "a"), ("p", 8, "a")], "k string, i int, t string")
    got = {(r.t, r.old_pos, r.new_pos) for r in tables.match_texts(old, new, ["k"], "t", "i").collect()}
    assert got == {("a", 0, 5), ("a", 2, 7), ("a", None, 8), ("b", 1, None), ("c", None, 6)}


def test_options_and_flags(spark):
    df = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0}, {"a": 9.0}), (2, None, None)], "i int, o map<string,double>, n map<string,double>")
    r = df.select(tables.option_key(F.col("o")).alias("k"), tables.merge_options(F.col("o"), F.col("n")).alias("m")).collect()
    assert [tuple(e) for e in r[0].k] == [("a", 1.0), ("b", 2.0)] and r[1].k == [] and r[0].m == {"a": 9.0, "b": 2.0} and r[1].m == {}
    limits = {"a": (0.0, 2.0, False), "b": (0.0, 10.0, True)}
    c = df.select(tables.clean_options(F.map_concat(F.col("n"), F.create_map(F.lit("b"), F.lit(2.5), F.lit("z"), F.lit(1.0))), limits).alias("c")).first().c
    assert c == {"a": 2.0, "b": 2.0}
    v = spark.createDataFrame([(1, "done", 0.1), (1, "done", 0.2), (1, "failed", 0.0), (2, "done", 0.3), (2, "done", 0.3), (3, "done", None)], "g int, status string, x double")
    got = sorted((r.g, r.x or 0, r.best) for r in tables.best_flags(v, ["g"], "x", True, "best").collect())
    assert got == [(1, 0, False), (1, 0.1, True), (1, 0.2, False), (2, 0.3, False), (2, 0.3, False), (3, 0, False)]


def test_grid(spark):
    c = spark.createDataFrame([("c", ["", "m", "m"], None), ("d", [], [])], "id string, models array<string>, lagen array<string>")
    limits = {"speed": (0.5, 1.5, False), "steps": (8.0, 64.0, True)}
    g = tables.build_grid(c, {"speed": [1.0, 9.0, 1.5]}, limits).orderBy("id", "place").collect()
    assert [(r.id, r.label) for r in g] == [("c", "Pretrain, speed 1"), ("c", "Pretrain, speed 1.5"), ("c", "m, speed 1"), ("c", "m, speed 1.5"), ("d", "speed 1"), ("d", "speed 1.5")]
    assert [r.label for r in tables.build_grid(c, {}, limits).collect()] == ["Pretrain", "m"]
    assert tables.build_grid(c, {"speed": [0.6 + i / 20 for i in range(9)]}, limits).where("id = 'c'").count() == 12


def test_search_and_state(spark):
    rows = [(1, "ok", "Der Regen", None, "2024-01-01"), (1, "pending", None, None, "2023-01-01"), (2, "failed", None, "im REGEN", None), (3, "needs_review", "x", "y", "2024-01-01")]
    df = spark.createDataFrame(rows, "chunk_id int, status string, raw_text string, asr_text string, saved_at string").withColumn("normalized_text", F.lit(None).cast("string"))
    now = tables.current(df)
    assert {(r.chunk_id, r.status) for r in now.collect()} == {(1, "ok"), (2, "failed"), (3, "needs_review")}
    assert [(r.chunk_id, r.total) for r in tables.search(now, "pruefen", "regen").collect()] == [(2, 3)]
    assert tables.search(now, "unbekannt", " ").count() == 3
    assert tables.search(now.limit(0), "", "").count() == 0

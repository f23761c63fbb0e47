"""Relational operators over projects, chunks, voices and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lesewerk.operators.ordered import join_keys

# Groups of states that a search can ask for.
STATUS_GROUPS = {"pruefen": ("needs_review", "failed"), "offen": ("pending", "synthesized"), "fertig": ("ok",)}
NEUTRAL = "neutral"
MOST_VARIANTS = 12


def current(chunks: DataFrame, key: str = "chunk_id", by: str = "saved_at") -> DataFrame:
    """The latest state of each chunk, by one aggregation (no window, so a map-side combine); null times are the oldest."""
    rest = [c for c in chunks.columns if c != key]
    when = F.coalesce(F.col(by).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    best = F.max(F.struct(when.alias("_at"), *rest)).alias("_best")
    return chunks.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*chunks.columns)


def search(chunks: DataFrame, status: str = "", query: str = "") -> DataFrame:
    """Chunks of a status group whose texts contain the query, without regard to case, with the number of all chunks.

    An unknown group filters nothing; the query is a literal text, not a pattern."""
    states = STATUS_GROUPS.get(status)
    out = chunks.where(F.col("status").isin(*states)) if states else chunks
    if q := query.strip().lower():
        hit = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q)) for c in ("raw_text", "normalized_text", "asr_text")]
        out = out.where(hit[0] | hit[1] | hit[2])
    # the total is one row: joined by a constant, it is broadcast
    total = chunks.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def progress(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by state and medians of the measured values of each group; one shuffle.

    The medians are exact. Both measures are stored with four digits, so a group of any size has at most some ten thousand
    distinct values, which are counted before the shuffle."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    cer = F.when(~F.isnan("cer") & (F.col("cer") >= 0), F.col("cer"))
    similar = F.when(~F.isnan("speaker_similarity"), F.when(F.col("speaker_similarity") > 1, F.col("speaker_similarity") / 100).otherwise(F.col("speaker_similarity")))
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("total"), is_("ok", "needs_review").alias("done"), is_("needs_review", "failed").alias("review"), is_("pending", "failed").alias("open"),
        F.every(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("complete"), F.round(F.median(cer), 6).alias("median_cer"), F.round(F.median(similar), 6).alias("median_similarity"),
    )


def effective_lage(chunk: Column, project: Column) -> Column:
    """The mood of a chunk: its own, else its project's, else neutral; an empty text is unset."""
    return F.coalesce(F.nullif(chunk, F.lit("")), F.nullif(project, F.lit("")), F.lit(NEUTRAL))


def with_voice(rows: DataFrame, voices: DataFrame, voice: str, lage: str) -> DataFrame:
    """Adds the voice's recording in the wanted mood, or the neutral one where there is none: voice_lage, reference_s, rate.

    The recordings of a voice become one map, so that one equi-join does both look-ups."""
    # of a repeated (name, lage) the greatest row holds
    once = voices.where("name is not null and lage is not null").groupBy("name", "lage").agg(F.max(F.struct("duration_s", "chars_per_second")).alias("_r")).select("name", "lage", "_r.*")
    by_voice = once.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("lage", F.struct("lage", "duration_s", "chars_per_second")))).alias("_lagen"))
    found = F.coalesce(F.try_element_at("_lagen", F.col(lage)), F.try_element_at("_lagen", F.lit(NEUTRAL)))
    joined = rows.join(by_voice, rows[voice] == by_voice["name"], "left").withColumn("_v", found)
    return joined.select(*rows.columns, F.col("_v.lage").alias("voice_lage"), F.col("_v.duration_s").alias("reference_s"), F.col("_v.chars_per_second").alias("rate"))


def match_texts(old: DataFrame, new: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Pairs equal texts of two versions: the n-th old occurrence with the n-th new one. Full outer: what has no partner stays.

    Returns (keys, text, nth, old_pos, new_pos)."""
    w = Window.partitionBy(*keys, text).orderBy(order)
    a = old.where(F.col(text).isNotNull()).select(*keys, text, F.col(order).alias("old_pos"), F.row_number().over(w).alias("nth"))
    b = new.where(F.col(text).isNotNull()).select(*keys, text, F.col(order).alias("new_pos"), F.row_number().over(w).alias("nth"))
    return a.join(b, [*keys, text, "nth"], "full")


def option_key(options: Column) -> Column:
    """A map as a sorted list of entries, so that it joins and groups; null and empty maps are the empty list."""
    return F.array_sort(F.map_entries(F.coalesce(options, F.create_map().cast("map<string,double>"))))


def merge_options(old: Column, new: Column) -> Column:
    """Entries of both maps, the new ones first; null maps are empty."""
    empty = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, o, n: F.coalesce(n, o))


def clean_options(options: Column, limits: dict[str, tuple[float, float, bool]]) -> Column:
    """Known options clamped to their limits, whole numbers where they have to be; unknown and null ones are dropped."""
    low, high, whole = ({k: v[i] for k, v in limits.items()} for i in range(3))
    of = lambda d, k: F.try_element_at(F.create_map(*[F.lit(x) for p in d.items() for x in p]), k)
    kept = F.map_filter(options, lambda k, v: k.isin(*limits) & v.isNotNull() & ~F.isnan(v))
    clamp = lambda k, v: F.least(F.greatest(v, of(low, k)), of(high, k))
    return F.transform_values(kept, lambda k, v: F.when(of(whole, k), F.bround(clamp(k, v), 0)).otherwise(clamp(k, v)))


def best_flags(variants: DataFrame, keys: list[str], value: str, smallest: bool, name: str) -> DataFrame:
    """Marks the done rows that hold their group's best value; none where all candidates tie, for nothing was won.

    Two aggregations of small groups (a grid has at most a dozen rows)."""
    candidate = (F.col("status") == "done") & F.col(value).isNotNull() & ~F.isnan(value)
    v = F.when(candidate, F.col(value))
    w = Window.partitionBy(*keys)
    best = (F.min(v) if smallest else F.max(v)).over(w)
    tied = F.min(v).over(w) == F.max(v).over(w)
    return variants.withColumn(name, F.coalesce(candidate & (F.col(value) == best) & ~tied, F.lit(False)))


def build_grid(comparisons: DataFrame, axes: dict[str, list[float]], limits: dict[str, tuple[float, float, bool]], most: int = MOST_VARIANTS) -> DataFrame:
    """The variants of each comparison: model x mood x option values, in this order, at most ``most``.

    Values are clamped, then repeated ones dropped; labels name only what varies. The axes are driver-side parameters, so
    every comparison's grid is made inside its row: no join, no shuffle."""
    made = {}
    for key in limits:  # axes in the order of the options
        if axes.get(key):
            lo, hi, whole = limits[key]
            made[key] = list(dict.fromkeys(float(round(x)) if whole else x for x in (max(lo, min(hi, v)) for v in axes[key])))
    combos: list[dict[str, float]] = [{}]
    for key, values in made.items():
        combos = [{**c, key: v} for c in combos for v in values]
    varies = {k for k, v in made.items() if len(v) > 1}
    lists = {c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())) for c in ("models", "lagen")}
    base = comparisons.select("id", lists["models"].alias("_m"), lists["lagen"].alias("_l"))
    base = base.withColumn("_others", (F.size("_m") > 1) | (F.size("_l") > 1)).where(F.lit(bool(made)) | F.col("_others"))
    orempty = lambda c: F.when(F.size(c) == 0, F.array(F.lit(""))).otherwise(F.col(c))
    base = base.select("id", "_m", "_l", "_others", F.posexplode(orempty("_m")).alias("m", "model")).select("*", F.posexplode(orempty("_l")).alias("l", "lage"))
    number = lambda k, v: f"{v:.0f}" if limits[k][2] else f"{v:g}"
    entry = lambda c, keys: " ".join(f"{k} {number(k, c[k])}" for k in c if k in keys)
    rows = [
        F.struct(
            F.lit(i).alias("o"), (F.create_map(*[F.lit(x) for p in c.items() for x in p]) if c else F.create_map().cast("map<string,double>")).alias("options"),
            F.lit(entry(c, varies)).alias("varying"), F.lit(entry(c, set(c))).alias("every"))
        for i, c in enumerate(combos)
    ]
    out = base.select("*", F.inline(F.array(*rows)))
    option_label = F.when(F.lit(bool(varies)) | F.col("_others"), F.col("varying")).otherwise(F.col("every"))
    parts = F.filter(
        F.array(F.when(F.size("_m") > 1, F.coalesce(F.nullif("model", F.lit("")), F.lit("Pretrain"))), F.when(F.size("_l") > 1, F.coalesce(F.nullif("lage", F.lit("")), F.lit(NEUTRAL))), F.nullif(option_label, F.lit(""))),
        lambda x: x.isNotNull())
    label = F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.nullif("model", F.lit("")), F.lit("Pretrain"))
    width = len(combos)
    place = (F.col("m") * F.when(F.size("_l") == 0, 1).otherwise(F.size("_l")) + F.col("l")) * width + F.col("o")
    return out.withColumn("place", place).where(F.col("place") < most).select("id", "place", "model", "lage", "options", label.alias("label"))


def unique_slugs(rows: DataFrame, keys: list[str], slug: str, order: str) -> DataFrame:
    """Equal slugs of a group are told apart: in order, a taken one gets the first of -2, -3, ... that isn't taken either.

    Each choice depends on all before it, so a group (a comparison's grid, at most a dozen variants) is one fold."""
    taken = F.aggregate(
        "_all", F.array().cast("array<string>"),
        lambda done, x: F.array_append(done, F.when(~F.array_contains(done, x["s"]), x["s"]).otherwise(
            F.element_at(F.filter(F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(x["s"], F.lit("-"), n.cast("string"))), lambda c: ~F.array_contains(done, c)), 1))))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(slug), F.lit("")).alias("s")))).alias("_all"))
    made = listed.select(*keys, F.inline(F.zip_with("_all", taken, lambda x, s: F.struct(x["o"].alias(order), s.alias(slug)))))
    others = [c for c in rows.columns if c not in (*keys, order, slug)]
    return made.select(*rows.columns) if not others else join_keys(rows.drop(slug), made, [*keys, order]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in place of, or beside them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def renamed(old: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Entries under new names (old_name, new_name). An entry that had the new name goes, as its place is taken; names that no entry has do
    nothing. Of several new names for one entry the least holds."""
    once = names.groupBy("old_name").agg(F.min("new_name").alias("new_name")).join(old.select(F.col(key).alias("old_name")).distinct(), "old_name")
    moved = old.join(once.withColumnRenamed("old_name", key), key).withColumn(key, F.col("new_name")).select(*old.columns)
    gone = once.select(F.col("old_name").alias(key)).union(once.select(F.col("new_name").alias(key))).distinct()
    return old.join(gone, key, "left_anti").select(*old.columns).unionByName(moved)


def removed(old: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Entries without those whose names are given."""
    return old.join(names.select(key).distinct(), key, "left_anti").select(*old.columns)


def lexicon_candidates(texts: DataFrame, words: Column, lexicon: DataFrame, source: str, fold_case: bool = True) -> DataFrame:
    """Words that the lexicon doesn't have, with the number of rows and the first source: (word, n, first_source)."""
    found = texts.select(F.col(source).alias("_s"), F.explode(words).alias("word"))
    counted = found.groupBy("word").agg(F.count("*").alias("n"), F.min("_s").alias("first_source"))
    fold = F.lower if fold_case else (lambda c: F.col(c))
    known = lexicon.select(fold("word").alias("_k")).distinct()
    return counted.join(known, fold("word") == F.col("_k"), "left_anti")


def toggle(rows: Column, other: Column) -> Column:
    """Symmetric difference of two arrays, in order."""
    return F.concat(F.array_except(rows, other), F.array_except(other, rows))

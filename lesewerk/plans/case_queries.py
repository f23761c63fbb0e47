"""Queries over literal cases: operators whose rules plain SQL can't state are held against results that are known.

A case table is a list of rows (inputs ..., expected ...). The query runs the operator on the inputs, its SQL is the same list with
the expected values. The values are fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lesewerk.functions import columns as c
from lesewerk.functions import german, metrics
from lesewerk.operators import curation, recordings, segment

RATE = 24000

# ---------------------------------------------------------------- fixed values: cases with their results
SPOKEN = [
    ("am 3. Mai", "am dritten Mai"), ("der 3. Platz", "der dritte Platz"), ("die 21. Auflage", "die einundzwanzigste Auflage"), ("im 19. Jahrhundert", "im neunzehnten Jahrhundert"),
    ("Es waren 50. Danach kam mehr.", "Es waren fünfzig. Danach kam mehr."), ("am 03.05.2024", "am dritten Mai zweitausendvierundzwanzig"), ("um 14:30 Uhr", "um vierzehn Uhr dreißig"),
    ("um 9:00 Uhr", "um neun Uhr"), ("1.250,50 €", "eintausendzweihundertfünfzig Euro fünfzig"), ("1 €", "ein Euro"), ("2.500 CHF", "zweitausendfünfhundert Franken"), ("20,00 €", "zwanzig Euro"),
    ("42,195 km", "zweiundvierzig Komma eins neun fünf Kilometer"), ("21 °C", "einundzwanzig Grad Celsius"), ("50 %", "fünfzig Prozent"), ("3 h", "drei Stunden"), ("1 Minute später", "eine Minute später"),
    ("1 min", "eine Minute"), ("1 kg", "ein Kilogramm"), ("z.B. heute", "zum Beispiel heute"), ("Dr. Meier bzw. Prof. Schmidt", "Doktor Meier beziehungsweise Professor Schmidt"),
    ("Siehe S. 12, Kap. 4.", "Siehe Seite zwölf, Kapitel vier."), ("3 Mio. Euro", "drei Millionen Euro"), ("Er wurde 1984 geboren", "Er wurde neunzehnhundertvierundachtzig geboren"),
    ("im Jahr 1848", "im Jahr achtzehnhundertachtundvierzig"), ("1500 Meter", "eintausendfünfhundert Meter"), ("0791234567", "null sieben neun eins zwei drei vier fünf sechs sieben"),
    ("Er lief in ca. 3 h.", "Er lief in circa drei Stunden."), ("2030", "zweitausenddreißig"), ("a.b@c.de schreibt", "a Punkt b at c Punkt de schreibt"), ("siehe https://x.example/y jetzt", "siehe jetzt"),
    ("2,5 Mrd. €", "zwei Komma fünf Milliarden €"), ("§ 5 und § 6", "Paragraf fünf und Paragraf sechs"), ("3 & 4", "drei und vier"), (None, None), ("", ""),
]
SENTENCES = [
    ("Dr. Meier sagte z.B., dass es u.a. daran liegt. Ende.", "Dr. Meier sagte z.B., dass es u.a. daran liegt.|Ende."), ("Am 3. Mai war es soweit. Danach nicht mehr.", "Am 3. Mai war es soweit.|Danach nicht mehr."),
    ("Es waren 50. Danach ging es weiter.", "Es waren 50.|Danach ging es weiter."), ("Das schrieb J. W. Goethe damals.", "Das schrieb J. W. Goethe damals."), ("Kapitel 3\n\nEs war so. Und so!", "Kapitel 3|Es war so.|Und so!"),
]
LEXICON = {"SWIFT": "Ssuift", "SWIFT Code": "Ssuift Kohd", "ACID": "Ässid", "MP3": "Em-Pe-3"}
LEXICON_CASES = [
    ("Die SWIFT-Nachricht kam.", "Die Ssuift-Nachricht kam."), ("swift und Swift und SWIFT", "Ssuift und Ssuift und Ssuift"), ("PLACIDE bleibt PLACIDE", "PLACIDE bleibt PLACIDE"),
    ("Der SWIFT Code lautet", "Der Ssuift Kohd lautet"), ("Als MP3 gespeichert.", "Als Em-Pe-drei gespeichert."),
]
METRICS = [
    ("Das ist ein Test.", "das ist ein test", 0.0, 0.0), ("Grüße aus München", "Gruesse aus Muenchen", 0.0, 0.0), ("Das ist ein Test", "Das ist kein Fest", 0.125, 0.5), ("Ein Satz", "", 1.0, 1.0),
    ("", "", 0.0, 0.0), ("", "etwas", 1.0, 1.0), ("a b c", "a c", 0.4, 0.333333), ("eins zwei", "zwei eins drei vier", 1.333333, 1.5),
]
BUDGETS = [(6.0, 20.0, 16.0), (9.0, 20.0, 13.0), (12.0, 20.0, 10.0), (30.0, 20.0, 10.0), (2.0, 8.0, 8.0)]
SPEEDS = [(17.0, 0.85), (20.0, 0.73), (11.0, 1.32), (14.0, None), (14.5, None), (15.0, None), (0.0, None), (None, None)]
TAGS = [("[laugh] Ja [x] nein", "[laugh] Ja nein", "laugh,x"), ("ohne", "ohne", ""), ("[ LAUGH ]  gut", "[ LAUGH ] gut", "laugh")]
NUMBERS = [("0.8, 1 1,2", "0.8,1.0,2.0"), ("a 3;x 4", "4.0"), ("", "")]
MODEL_FILES = [("m", "run/model_100.pt"), ("m", "run/model_last.pt"), ("m", "run/model_200.safetensors"), ("m", "run/vocab.txt"), ("m", "vocab.txt"), ("v", "bigvgan/model_1.safetensors"), ("v", "model_1.safetensors"), ("v", "vocab.txt")]
CHOSEN = [("m", "run/model_200.safetensors", "run/vocab.txt"), ("v", "model_1.safetensors", "vocab.txt")]
CHECKPOINTS = ["a/model_20.pt", "a/model_last.pt", "a/model_100.pt", "a/model_x.pt", "a/other.pt"]
ORDERED = [(0, "a/model_last.pt"), (1, "a/model_100.pt"), (2, "a/model_20.pt"), (3, "a/model_x.pt")]
STALE = [("p", 5, 9, True), ("q", 9, 5, True), ("r", None, 5, False), ("s", 3, 5, False)]
#: Tracks as (seconds, amplitude) of a tone of 200 Hz, with the text of a reading.
STARTS = [
    ("stray", [(0.10, 0.0), (0.14, 0.15), (0.36, 0.0), (2.0, 0.4)], "Das ist so.", 0.59, ""), ("wanted", [(0.10, 0.0), (0.14, 0.15), (0.36, 0.0), (2.0, 0.4)], "Ja, das ist so.", None, "expected"),
    ("speech", [(2.0, 0.4)], "Das ist so.", None, "long"), ("nothing", [(2.0, 0.0)], "Das ist so.", None, "silent"), ("no pause", [(0.10, 0.0), (0.14, 0.15), (0.10, 0.0), (2.0, 0.4)], "Das ist so.", None, "pause"),
    ("late", [(0.30, 0.0), (0.14, 0.15), (0.36, 0.0), (2.0, 0.4)], "Das ist so.", None, "late"), ("alone", [(0.10, 0.0), (0.14, 0.15), (0.80, 0.0)], "Das ist so.", None, "alone"),
]
SEGMENTS = [("three", [(5.0, 0.3), (0.8, 0.0), (6.0, 0.3), (0.8, 0.0), (4.0, 0.3)], 3, 0), ("short", [(5.0, 0.3), (2.5, 0.0), (1.2, 0.3), (2.5, 0.0), (5.0, 0.3)], 2, 1), ("long", [(18.0, 0.3)], 0, 1), ("silent", [(5.0, 0.0)], 0, 0)]
REFERENCES = [
    ("good", [(8.0, 0.3), (0.3, 0.0)], "x" * 110, "", True), ("short", [(2.0, 0.3), (0.3, 0.0)], "x" * 30, "short", True), ("long", [(14.0, 0.3), (0.3, 0.0)], "x" * 200, "long", True), ("clipped", [(8.0, 1.0), (0.3, 0.0)], "x" * 110, "clipped", True),
    ("quiet", [(8.0, 0.02), (0.3, 0.0)], "x" * 110, "quiet", True), ("pauses", [(1.5, 0.3), (6.0, 0.0)], "x" * 20, "pauses", True), ("label", [(8.0, 0.3), (0.3, 0.0)], "Anna", "few characters", True),
    ("much", [(8.0, 0.3), (0.3, 0.0)], "x" * 300, "many characters", True), ("broken", [(8.0, 0.3)], "x" * 110, "abrupt", True), ("nothing", [(6.0, 0.0)], "", "quiet,pauses", False),
]
WORDS = [
    ("heard", [(0.30, 0.4), (0.10, 0.0), (0.60, 0.4)], "Das ist gut", [("äh", 0.0), ("das", 0.45), ("ist", 0.6), ("gut", 0.8)], 0.39, "das ist gut"),
    ("at once", [(1.0, 0.4)], "Das ist gut", [("das", 0.0), ("ist", 0.2), ("gut", 0.4)], None, "das ist gut"),
]
# -----------------------------------------------------------------------------


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({names})"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _tracks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows whose second column is the sections of a track, with the track's samples and rate in its place."""
    df = spark.createDataFrame([(r[0], [float(x) for section in r[1] for x in section], *r[2:]) for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for flat in batch.column(1).to_pylist():
                parts = [np.sin(2 * np.pi * 200 * np.arange(int(s * RATE)) / RATE) * a for s, a in zip(flat[::2], flat[1::2], strict=True)]
                made.append(np.concatenate(parts).astype(np.float32))
            rest = [k for k in range(batch.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], pa.array(made, pa.list_(pa.float32())), pa.array([RATE] * len(made), pa.int32())], [*[batch.schema.names[k] for k in rest], "samples", "rate"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for k, f in enumerate(df.schema) if k != 1)
    return df.mapInArrow(run, f"{kept}, samples array<float>, rate int")


def spoken_cases(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [r[:1] for r in SPOKEN], "source string").select("source", german.spoken_column("source").alias("spoken"))


def lexicon_cases(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [r[:1] for r in LEXICON_CASES], "source string").select("source", german.spoken_column("source", LEXICON).alias("spoken"))


def sentence_cases(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold one sentence each, put together again by text."""
    x = _rows(spark, [(k, r[0]) for k, r in enumerate(SENTENCES)], "k int, source string")
    made = segment.chunk_texts(x, ["k"], "source", rate=1.0, target_s=1.0, most_s=10_000.0).groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "raw_text"))), lambda e: e["raw_text"]), "|").alias("sentences"))
    return x.join(made, "k").select("source", "sentences")


def metric_cases(spark: SparkSession, d: str) -> DataFrame:
    x = _rows(spark, [r[:2] for r in METRICS], "reference string, heard string")
    return metrics.with_error_rates(x, "reference", "heard").select("reference", "heard", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


def budget_cases(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [r[:2] for r in BUDGETS], "reference_s double, target_s double").select("reference_s", "target_s", c.chunk_budget("target_s", F.lit(22.0), "reference_s").alias("budget"))


def speed_cases(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [r[:1] for r in SPEEDS], "rate double").select("rate", c.suggested_speed("rate").alias("speed"))


def tag_cases(spark: SparkSession, d: str) -> DataFrame:
    x = _rows(spark, [r[:1] for r in TAGS], "source string")
    return x.select("source", c.strip_tags("source", ["laugh"]).alias("kept"), F.array_join(c.find_tags("source"), ",").alias("tags"))


def number_list_cases(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [r[:1] for r in NUMBERS], "source string").select("source", F.array_join(F.transform(c.number_list("source"), lambda v: v.cast("string")), ",").alias("numbers"))


def model_file_cases(spark: SparkSession, d: str) -> DataFrame:
    return curation.model_files(_rows(spark, MODEL_FILES, "key string, name string"), "key")


def checkpoint_cases(spark: SparkSession, d: str) -> DataFrame:
    """The place of each checkpoint: the last one first, then by falling step."""
    listed = curation.checkpoint_order(_rows(spark, [(x,) for x in CHECKPOINTS], "name string"))
    return listed.agg(F.collect_list("name").alias("l")).select(F.posexplode("l").alias("place", "name"))


def stale_cases(spark: SparkSession, d: str) -> DataFrame:
    files = _rows(spark, [r[:2] for r in STALE if r[1] is not None] + [("p", 12)], "key string, modified bigint")
    return curation.stale_outputs(files, _rows(spark, [(r[0], r[2]) for r in STALE], "key string, modified bigint"), ["key"])


_KINDS = {"": "", "hinter dem ersten Wort": "expected", "dauert": "long", "am Anfang ist nichts": "silent", "nur ": "pause", "beginnt erst": "late", "nach der Pause": "alone"}


def start_cases(spark: SparkSession, d: str) -> DataFrame:
    """Where a stray sound at the beginning ends, or which rule speaks against a cut."""
    out = recordings.judge_starts(_tracks(spark, [r[:3] for r in STARTS], "name string, sections array<double>, raw_text string"))
    kind = F.when(F.col("reason") == "", "")
    for begin, name in _KINDS.items():
        kind = kind.when(F.col("reason").startswith(begin), name) if begin else kind
    return out.select("name", F.round("cut", 2).alias("cut"), kind.alias("kind"))


def segment_cases(spark: SparkSession, d: str) -> DataFrame:
    found = recordings.cut_utterances(_tracks(spark, [r[:2] for r in SEGMENTS], "name string, sections array<double>"), "name")
    every = _rows(spark, [(r[0],) for r in SEGMENTS], "name string")
    return every.join(found.groupBy("name").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")), "name", "left").select("name", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))


def reference_cases(spark: SparkSession, d: str) -> DataFrame:
    x = _tracks(spark, [r[:3] for r in REFERENCES], "name string, sections array<double>, transcript string")
    return recordings.inspect_recordings(x).select("name", F.array_join("warnings", ",").alias("warnings"), "ok")


def lead_in_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, s, t, [{"text": w, "start": b, "end": b + 0.1} for w, b in words]) for n, s, t, words, *_ in WORDS]
    x = _tracks(spark, rows, "name string, sections array<double>, raw_text string, words array<struct<text:string,start:double,end:double>>")
    out = recordings.cut_lead_ins(x.withColumn("normalized_text", F.col("raw_text")))
    return out.select("name", F.round("trimmed_bleed_s", 2).alias("cut"), "heard")


def dataset_cases(spark: SparkSession, d: str) -> DataFrame:
    """The segment tracks as a data set: utterances numbered over all of them; a stand-in hears as many characters as fit."""
    heard = lambda rows: rows.withColumn("heard", F.rpad(F.lit("Am 3. Mai. "), F.floor(F.col("duration_s") * 14).cast("int"), "x "))
    good, bad = recordings.build_dataset(_tracks(spark, [r[:2] for r in SEGMENTS], "path string, sections array<double>"), heard, german.spoken_column)
    u = good.select(F.col("index").cast("bigint").alias("number"), "file", "source", F.substring("text", 1, 14).alias("text"))
    return u.unionByName(bad.select(F.lit(0).cast("bigint").alias("number"), F.lit("").alias("file"), "source", F.substring_index("reason", " -- ", 1).alias("text")))


CASES: dict[Callable[[SparkSession, str], DataFrame], str] = {
    spoken_cases: values_sql(SPOKEN, "source, spoken"), lexicon_cases: values_sql(LEXICON_CASES, "source, spoken"), sentence_cases: values_sql(SENTENCES, "source, sentences"),
    metric_cases: values_sql(METRICS, "reference, heard, cer, wer"), budget_cases: values_sql(BUDGETS, "reference_s, target_s, budget"), speed_cases: values_sql(SPEEDS, "rate, speed"),
    tag_cases: values_sql(TAGS, "source, kept, tags"), number_list_cases: values_sql(NUMBERS, "source, numbers"), model_file_cases: values_sql(CHOSEN, "key, checkpoint, vocabulary"),
    checkpoint_cases: values_sql(ORDERED, "place, name"), stale_cases: values_sql([(k, m, s) for k, _, m, s in STALE], "key, modified, stale"),
    start_cases: values_sql([(n, cut, kind) for n, _, _, cut, kind in STARTS], "name, cut, kind"), segment_cases: values_sql([(n, g, b) for n, _, g, b in SEGMENTS], "name, good, bad"),
    reference_cases: values_sql([(n, w, ok) for n, _, _, w, ok in REFERENCES], "name, warnings, ok"), lead_in_cases: values_sql([(n, cut, heard) for n, _, _, _, cut, heard in WORDS], "name, cut, heard"),
    dataset_cases: values_sql(
        [(1, "wavs/utt_00001.wav", "short", "Am dritten Mai"), (2, "wavs/utt_00002.wav", "short", "Am dritten Mai"), (3, "wavs/utt_00003.wav", "three", "Am dritten Mai"), (4, "wavs/utt_00004.wav", "three", "Am dritten Mai"),
         (5, "wavs/utt_00005.wav", "three", "Am dritten Mai"), (0, "", "short", "zu kurz"), (0, "", "long", "keine Pausen erkennbar")], "number, file, source, text"),
}
QUERIES = {f.__name__: f for f in CASES}
SQL = {f.__name__: sql for f, sql in CASES.items()}

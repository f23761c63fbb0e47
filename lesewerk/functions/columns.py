"""Text and number functions as native expressions: they stay in the JVM and in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lesewerk.functions.german import ONES, TENS

# Fixed values
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
LETTER_NAMES = dict(
    zip(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ0123456789",
        "A Be Ze De E Ef Ge Ha I Jot Ka El Em En O Pe Ku Er Es Te U Vau We Iks Ypsilon Zett Ä Ö Ü Null Eins Zwei Drei Vier Fünf Sechs Sieben Acht Neun".split(),
        strict=True,
    )
)
#: What a sentence piece may end with so that no full stop is missing, and the marks that may stand behind it.
SENTENCE_ENDS, CLOSERS = ".!?…:,;", "\"')]»›“”"
MAX_HEADING_CHARS = 70
COMFORTABLE_RATE, PLAUSIBLE_RATES = 14.5, (7.0, 24.0)
#: Margins in dB between background, speech and the threshold of silence.
SILENCE_MARGIN, SPEECH_DROP, MIN_SILENCE, MAX_SILENCE = 10.0, 25.0, -55.0, -20.0
#: White space as Python's ``str.split`` sees it.
SPACE = r"[\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def clean_typography(c: Column | str) -> Column:
    """One space, one kind of quotation mark, dashes between spaces as commas, an ellipsis as a full stop."""
    t = F.translate(col(c), "  ", "  ")
    t = F.regexp_replace(t, " [–—] ", ", ")
    return F.translate(t, "„“”»«‚‘’…", "\"\"\"\"\"'''.")


def drop_links(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"\bhttps?://\S+", ""), r"\bwww\.\S+", "")


def collapse_space(c: Column | str) -> Column:
    t = F.regexp_replace(col(c), r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ([,.;:!?])", "$1")
    return strip_space(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def comparison_form(c: Column | str) -> Column:
    """Lower case, umlauts written out, everything but letters, digits and underscores a space, single spaces.

    The text has to be composed (NFC) already; ``metrics.composed`` does that."""
    t = F.lower(col(c))
    for a, b in UMLAUTS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " ")
    return F.trim(t)


def slug(c: Column | str, most: int | None = 40, default: str = "variante") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    t = F.substring(t, 1, most) if most else t
    return F.when(t == "", F.lit(default)).otherwise(t)


def spell_out(c: Column | str, separator: str = "-") -> Column:
    """'USB' -> 'U-Es-Be'; other characters stay, white space goes."""
    names = F.create_map(*[F.lit(x) for pair in LETTER_NAMES.items() for x in pair])
    letters = F.filter(F.split(F.regexp_replace(F.upper(col(c)), SPACE, ""), ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(names, x), x)), separator)


def acronyms(c: Column | str) -> Column:
    """Runs of capitals and digits with two letters at least, each once, in the order of their first occurrence."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?<![\p{L}\p{N}_])([A-ZÄÖÜ][A-ZÄÖÜ0-9]+)(?![\p{L}\p{N}_])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(F.regexp_replace(w, "[0-9]", "")) >= 2))


def join_raw(left: Column | str, right: Column | str) -> Column:
    """Two pieces as one text, with a full stop between them where the first has no end mark."""
    a, b = strip_space(left), strip_space(right)
    core = F.rtrim(a, F.lit(CLOSERS))
    dot = F.when((core != "") & ~F.contains(F.lit(SENTENCE_ENDS), F.substring(core, -1, 1)), ".").otherwise("")
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, dot, F.lit(" "), b))


def heading_text(line: Column | str, following: Column | str) -> Column:
    """The heading that a line is, or null: marked by '#', or short, without an end mark, and not continued in lower case."""
    t, nxt = strip_space(line), F.regexp_replace(F.coalesce(col(following), F.lit("")), f"^{SPACE}+", "")
    marked = F.regexp_extract(t, r"^#{1,6}[ \t]+(.+?)[ \t]*#*$", 1)
    lower = lambda c: F.rlike(c, F.lit(r"^\p{Ll}"))
    plain = (t != "") & (F.length(t) <= MAX_HEADING_CHARS) & ~F.contains(F.lit(SENTENCE_ENDS), F.substring(t, -1, 1)) & ~lower(t) & ~F.rlike(nxt, F.lit(r"^[\p{Ll},;)]"))
    return F.when(marked != "", marked).when(plain, t)


def strip_tags(c: Column | str, supported: list[str]) -> Column:
    """Drops [tags] that aren't supported, then single spaces."""
    keep = "|".join(s.lower() for s in supported) or r"(?!)"
    t = F.regexp_replace(col(c), rf"(?iu)\[(?!\s*(?:{keep})\s*\])[^\[\]]{{1,40}}\]", "")
    return strip_space(F.regexp_replace(t, f"{SPACE}+", " "))


def find_tags(c: Column | str) -> Column:
    """The [tags] of a text in lower case, each once, in the order of their first occurrence."""
    found = F.regexp_extract_all(col(c), F.lit(r"\[([^\[\]]{1,40})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(strip_space(t))))


# ---- number words as expressions; the same arithmetic runs in SQL


def _below_hundred(n: Column, one: str) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, ["", "", *TENS]))
    unit = n % 10
    tail = F.when(unit == 0, "").when(unit == 1, "einund").otherwise(F.concat(F.get(ones, unit.cast("int")), F.lit("und")))
    return F.when(n == 0, "").when(n == 1, one).when(n < 20, F.get(ones, n.cast("int"))).otherwise(F.concat(tail, F.get(tens, F.floor(n / 10).cast("int"))))


def _below_thousand(n: Column, one: str) -> Column:
    ones = F.array(*map(F.lit, ["", "ein", *ONES[2:10]]))
    h = F.floor(n / 100).cast("int")
    return F.concat(F.when(h > 0, F.concat(F.get(ones, h), F.lit("hundert"))).otherwise(""), _below_hundred(n % 100, one))


def cardinal(c: Column | str) -> Column:
    """Number word of 0 to 999999; null beyond."""
    n = col(c)
    k = F.floor(n / 1000)
    word = F.concat(F.when(k > 0, F.concat(_below_thousand(k, "ein"), F.lit("tausend"))).otherwise(""), _below_thousand(n % 1000, "eins"))
    return F.when(n == 0, ONES[0]).when((n > 0) & (n < 1_000_000), word)


def ordinal(c: Column | str) -> Column:
    """Ordinal word of 1 to 999; null beyond."""
    n = col(c)
    rest = n % 100
    special = F.when(rest == 1, "erste").when(rest == 3, "dritte").when(rest == 7, "siebte").when(rest == 8, "achte")
    hundreds = F.when(n >= 100, F.concat(_below_thousand(n - rest, ""), F.lit(""))).otherwise("")
    tail = F.coalesce(special, F.concat(_below_hundred(rest, ""), F.when((rest > 0) & (rest < 20), "te").otherwise("ste")))
    word = F.concat(hundreds, tail)
    return F.when((n >= 1) & (n <= 999), F.when(n == 100, "hundertste").otherwise(word))


def year(c: Column | str) -> Column:
    n = col(c)
    rest = n % 100
    hundreds = F.concat(cardinal(F.floor(n / 100)), F.lit("hundert"), F.when(rest > 0, cardinal(rest)).otherwise(""))
    return F.when((n >= 1100) & (n <= 1999), hundreds).otherwise(cardinal(n))


# ---- numbers


def derive_seed(project: Column | str, index: Column | str, attempt: Column | str) -> Column:
    """A seed that depends on nothing but its arguments: the first four bytes of a SHA-1 modulo 2^31 - 1."""
    key = F.concat_ws(":", col(project), col(index).cast("string"), col(attempt).cast("string"))
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % 2147483647


def suggested_speed(rate: Column | str) -> Column:
    """Factor that brings a voice to a comfortable pace; null where it is close or unknown."""
    f = COMFORTABLE_RATE / F.nullif(col(rate), F.lit(0.0))
    return F.when((col(rate) > 0) & ~f.between(0.95, 1.05), F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.5), f)), 2))


def chunk_budget(target: Column | str, limit: Column | str, reference: Column | str, most_reference: float = 12.0) -> Column:
    """Seconds that a chunk may last: the target, but at most what the limit leaves beside the reference, and 4 at least."""
    room = F.least(col(target), col(limit) - F.least(F.coalesce(col(reference), F.lit(0.0)), F.lit(most_reference)))
    return F.when(col(limit).isNull(), col(target)).otherwise(F.greatest(F.lit(4.0), room))


def chunk_limits(target: Column | str, most: Column | str, limit: Column | str, reference: Column | str) -> Column:
    """(budget, most) as a struct: the budget of a chunk, which is also its maximum where it lies below the target."""
    budget = chunk_budget(target, limit, reference)
    return F.struct(budget.alias("budget"), F.when(budget < col(target), budget).otherwise(col(most)).alias("most"))


def silence_threshold(floor: Column | str, speech: Column | str) -> Column:
    return F.least(F.greatest(col(floor) + SILENCE_MARGIN, col(speech) - SPEECH_DROP, F.lit(MIN_SILENCE)), F.lit(MAX_SILENCE))


def decibel(level: Column | str) -> Column:
    return 20.0 * F.log10(F.greatest(col(level), F.lit(1e-12)))


def duration_text(seconds: Column | str) -> Column:
    """'48 s', '6:12 min', '1:04:30 h'; halves are rounded to the even second."""
    s = F.bround(col(seconds), 0).cast("bigint")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(m.cast("string"), F.lit(":"), two(r), F.lit(" min")))
        .otherwise(F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r), F.lit(" h")))
    )


def moment_text(iso: Column | str) -> Column:
    """'dd.MM.yyyy, HH:mm' of an ISO text in UTC; what isn't one stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(col(iso)), "dd.MM.yyyy, HH:mm"), col(iso))


def training_plan(seconds: Column | str, epochs: Column | str, frames: int = 1600, frames_a_second: float = 93.75) -> Column:
    """Steps of a training run over so many seconds of audio, as a struct."""
    step_s = F.lit(frames / frames_a_second)
    per_epoch = F.greatest(F.lit(1), F.bround(col(seconds) / step_s, 0).cast("bigint"))
    total = per_epoch * col(epochs)
    warmup = F.greatest(F.lit(10), F.least(F.lit(200), F.floor(total / 10)))
    save = F.greatest(F.lit(50), F.least(F.lit(1000), F.floor(total / 5)))
    last = F.greatest(F.lit(25), F.least(F.lit(500), F.floor(save / 2)))
    return F.struct(step_s.alias("step_seconds"), per_epoch.alias("steps_per_epoch"), total.alias("total_steps"), warmup.alias("warmup_steps"), save.alias("save_every"), last.alias("last_every"))


def make_id(name: Column | str, at: Column | str, default: str = "projekt") -> Column:
    """'20240108-062641-name': sorts by time."""
    return F.concat(F.date_format(col(at), "yyyyMMdd-HHmmss"), F.lit("-"), slug(name, 40, default))


def expects_pause(text: Column | str) -> Column:
    """Whether a mark that asks for a pause follows the first word; false for blank texts."""
    first = F.rtrim(F.regexp_extract(strip_space(text), r"^(\S+)", 1), F.lit(CLOSERS))
    return F.coalesce(F.contains(F.lit(",;:.!?…–—-"), F.substring(first, -1, 1)) & (first != ""), F.lit(False))


def fixed_duration(text: Column | str, transcript: Column | str, reference_s: Column | str, speed: Column | str, rate: float = 14.0, tail: float = 0.5, most_chars: int = 80) -> Column:
    """Seconds, reference included, for a short text to which a share by bytes would give too little time; else null."""
    pace = F.greatest(col(speed), F.lit(0.1))
    n = F.octet_length(col(transcript))
    by_bytes = col(reference_s) / F.nullif(n, F.lit(0)) * F.octet_length(col(text)) / pace
    needed = F.length(col(text)) / F.lit(rate) / pace + tail
    return F.when((F.length(col(text)) <= most_chars) & (col(reference_s) > 0) & (by_bytes < needed), col(reference_s) + needed)


def number_list(c: Column | str) -> Column:
    """Numbers of a text that is parted by commas or white space; what is no number is dropped, repeated ones too."""
    return F.array_distinct(F.array_compact(F.transform(F.split(col(c), f"(?:,|{SPACE})+"), lambda x: F.when(x != "", x.try_cast("double")))))


def over_length(c: Column | str, seconds: Column | str | None, rate: float = 14.0) -> Column:
    """Whether a text is longer than an engine's limit in seconds allows; never without a limit."""
    limit = F.lit(0) if seconds is None else F.coalesce(F.floor(col(seconds) * rate), F.lit(0))
    return (limit > 0) & (F.length(col(c)) > limit)

"""Keyword-stuffed pages, link lists and product tags.

Method: thresholds on word and n-gram shares, duplicate lines, link text, separators and missing function words, calibrated
per language. For each line of a text a worker measures

- its share of link text (addresses, anchors and their captions),
- its share of function words of the text's language,
- its share of words in pairs of content words that recur in different sentences, and of recurring content words,
- separators, price and tag marks for each word, and whether it is a copy of an earlier line,
- whether it is an entry of a numbered, timed, spoken-role or arrow list, and whether it ends like a sentence.

The usual share of function words and the usual upper shares of recurring pairs and words are percentiles over the distinct
texts of a language; how far the upper shares count is bounded by the median and by fixed values, so that a language full of
stuffed pages doesn't pass for one that is written so. A line is junk if it is link text or product tags, or if it lacks the function words of its
language while its words recur, stand between separators or don't end as a sentence; a whole text is junk if recurring pairs or
words go well beyond what the language's texts reach (keywords strewn into sentences or dressed as such). A document is
found if junk makes up at least ``share`` of it. Sentences and lines that are mere copies count once for the recurrence, so
that refrains don't look like keywords; sentences that come three times and lack the function words are junk themselves.

Null, empty and blank texts, and those of less than ``LEAST_WORDS`` words without links, are never found. Rows of one
document count once. No labels are used; they serve the tests.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesewerk.session import ensure_checkpoint_dir

# Common function words by language.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht nur noch mit von vom zu zum zur in im an am auf aus bei nach vor über unter als wie wenn dass ist war sind hat habe es er sie ich man sich auch so was wer wo dann doch mehr kein keine durch um bis ohne gegen wurde weil ob neben zwischen bevor nachdem sobald damit während früher dort danach trotz seit jedes kaum hieß",
    "en": "the a an and or but not of to in on at by for with from as is was are were be been it he she they i you we that this there had has have when who what so all his her its who said only more than or no near behind why nobody before after if out up about them some would which",
    "fr": "le la les l un une des de du d et ou mais ne pas que qui en au aux à dans sur pour par avec sans est était sont ce cette il elle on je vous nous se s y dit soit plus puis là près vers personne pourquoi après comme si tout leur même quand où",
    "es": "el la los las un una de del y o pero no que en a al por para con sin es era son se lo le su sus yo como más hasta había allí esta este dijo qué después junto nada siempre si cuando porque donde muy",
    "it": "il lo la i gli le un una di del della e o ma non che in a al per con senza è era sono si come più questo",
    "ru": "и в во не на что он она они я с со как а то все был была было у из к за от по для но здесь там где без после",
    "ar": "في من على إلى عن ثم هل أين ما لا يا و أن هذا هذه كان له قرب بعد قال",
    "hi": "है में की के का को से और ने पर था थी यह वह कि नहीं कहाँ कितनी भी एक कहा",
}
#: Function characters of scripts without spaces, and function words of Thai.
FUNCTION_SIGNS = {"ja": "はがをにのともでだたかへっい", "zh": "的了在是我不你他着这那也却里很都和没个吗", "th": "ไม่ มี ที่ และ ว่า ใน แต่ แล้ว อยู่ หรือ ใกล้ ยัง ไป ของ"}

_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ALL = frozenset().union(*_SETS.values())
_JA, _ZH, _TH = frozenset(FUNCTION_SIGNS["ja"]), frozenset(FUNCTION_SIGNS["zh"]), tuple(FUNCTION_SIGNS["th"].split())
_TOP = "example|test|com|net|org|info|biz|shop|de|at|ch|io|fr|es|ru|cn|jp|co"
_DOT = r"(?:\.|\s?\[\.\]\s?|\s\.\s|\s(?:punkt|dot|point|punto)\s)"
# All repetitions are bounded: no text, however long or odd, takes more than linear time.
#: Anchors with their captions, addresses, and addresses whose points are written in another way.
_LINK = re.compile(
    rf"<a\s[^>]{{0,2000}}>.{{0,2000}}?</a>|!?\[[^\]\n]{{0,300}}\]\([^)\s]{{0,2000}}\)|\[url[^\]]{{0,2000}}\].{{0,2000}}?\[/url\]|(?:https?://|ftp://|www\.)[^\s<>\")\]]+(?:{_DOT}[^\s<>\")\]]+)*|(?:\b[\w-]{{1,63}}{_DOT}){{1,4}}(?:{_TOP})\b(?:/[^\s<>\")\]]*(?:{_DOT}html?)?)?", re.S)
#: Without one of these a text has no link. Both begin with something rare, so that most texts are passed over fast.
_ADDRESS = re.compile(rf"\.(?:{_TOP})\b")
_LINK_SIGNS = ("http", "ftp:", "www", "<a", "](", "[url", "[.]")
#: Points between white space of any kind, and such points as words, with the words themselves.
_LONE_POINT, _POINT_WORD, _POINT_WORDS = re.compile(r"\.\s(?<=\s\.\s)"), re.compile(r"(?:punkt|dot|point|punto)\s"), ("punkt", "dot", "point", "punto")
_TAG = re.compile(r"<[^<>]{1,200}>")
#: Letters with the marks that follow them.
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])*")
_PLAIN_WORD, _MARK = re.compile(r"[^\W\d_]+"), re.compile("[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]")
_LINE = re.compile(r"\n|\t|\s\+\+\+\s")


def _lines(text: str) -> list[str]:
    return _LINE.split(text) if "\t" in text or "+++" in text else text.split("\n")


_SENTENCE = re.compile(r"[.!?…।؟。！？]+")
_SEPARATOR = re.compile(r"[|;•·>/*★☆+=#~]|,(?=\s)|\s[-–]\s")
_ENDS, _CLOSERS = ".!?…।؟。！？", "\"”“»«›‹’')」』] \r\x0b\x0c\u00a0\u202f"
_PRODUCT = re.compile(r"\d{1,9}[.,]\d{2}\s?(?:€|\$|£|¥|eur\b|usd\b)|[€$£¥]\s?\d{1,9}(?:[.,]\d{2})?|art\.-nr\.|★+☆*|(?<!\w)#\w+")
_MARKED = re.compile(r"[€$£¥★#]|art\.-nr|eur\b|usd\b")
_ENTRY = re.compile(r"\s*(?:\d+[.):]?\s+.*\d\s*$|\[?\d{1,3}\]?[.):]?\s+\S|.*\.{3,}\s*\d+\s*$|.*\d{1,2}:\d{2}\s*$|[^\s:,|][^:,|]{0,28}:\s+[^|;,#]{1,60}$|\S.{0,40}\s(?:→|->|=>)\s)")
#: A speaker, role or label before a line's text.
_LABEL = re.compile(r"\s*(?:\[[^\]]{1,30}\]|[^\s:,|][^:,|]{0,28}:)\s+(?=\S)")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
#: Languages that documents are sorted into; 'other' is a text without any function word.
LANGUAGES = ("de", "en", "fr", "es", "it", "ru", "ar", "hi", "ja", "zh", "th", "other")


#: A longer line isn't an entry of a list.
LONGEST_ENTRY = 400
#: No threshold of function words lies above this share: LOW times a median of at most 1.
MOST_LOW = 0.45


def _language(words: Counter) -> str:
    """The language whose function words make up most of a text; by script where that is enough."""
    unspaced = [w for w in words if w >= "฀" and _UNSPACED.match(w)] if words and max(words) >= "฀" else ()
    if unspaced:
        glued = sum(words[w] * len(w) for w in unspaced)
        if glued > 3 * (sum(words.values()) - sum(words[w] for w in unspaced)):
            sample = "".join(unspaced)
            if any("฀" <= c <= "๿" for c in sample):
                return "th"
            return "ja" if sum("぀" <= c <= "ヿ" for c in sample) * 8 > len(sample) else "zh"
    best, most = "other", 0
    common = _ALL.intersection(words)
    for name, known in _SETS.items():
        if (n := sum(map(words.__getitem__, known & common))) > most:
            best, most = name, n
    return best


def _glued_share(words: list[str], language: str) -> float:
    """Share of function signs, four characters a sign, in words of a script without spaces."""
    hits = 0.0
    for w in words:
        n = sum(w.count(p) for p in _TH) if language == "th" else sum(c in (_JA if language == "ja" else _ZH) for c in w)
        hits += min(1.0, 4 * n / len(w))
    return hits / len(words)


def _may_link(low: str) -> bool:
    """Whether a lower-case text can have links at all."""
    if any(x in low for x in _LINK_SIGNS) or _ADDRESS.search(low) or _LONE_POINT.search(low):
        return True
    return any(x in low for x in _POINT_WORDS) and any(low[m.start() - 1 : m.start()].isspace() for m in _POINT_WORD.finditer(low))


def _is_entry(line: list) -> bool:
    return not line[1] and len(line[0]) <= LONGEST_ENTRY and _ENTRY.match(line[0]) is not None


def _lacks(words: list[str]) -> bool:
    """Whether a sentence has next to no function words of any language: a page may quote another one."""
    if any(map(_UNSPACED.match, words)):
        return max(_glued_share(words, x) for x in FUNCTION_SIGNS) < LEAST_LOW
    return sum(map(_ALL.__contains__, words)) < LEAST_LOW * len(words)


def measure(text: str) -> tuple[str, float, float, list[tuple]]:
    """(language, share of recurring pairs, share of recurring words, lines) of a text. A line is (characters, link share,
    function share, share of recurring pairs, share of recurring words, separators a word, product marks a word, words, whether it
    repeats an earlier line, whether it is a list entry, whether it ends like a sentence, share of its words in sentences that come three
    times in the text and lack function words)."""
    language, pairs, often, rows, _ = _measure(text)
    return language, pairs, often, [(*r[:9], bool(r[9]), *r[10:]) for r in rows]


def summed(text: str) -> tuple[str, float, float, int, float, int, float, list[tuple]]:
    """(language, pairs, often, characters, characters times function share, words, words times function share, lines): the sums are over
    all lines, the lines are those that can be junk or entries of a list under any thresholds. Prose that ends its sentences has none."""
    language, pairs, often, rows, list_like = _measure(text)
    size, words = sum(r[0] for r in rows), sum(r[7] for r in rows)
    by_size, by_words = sum(r[0] * r[2] for r in rows), sum(r[7] * r[2] for r in rows)
    kept = [(*r[:9], bool(r[9]), *r[10:]) for r in rows if list_like or r[9] is not None or r[1] > 0.49 or r[6] > 0.079 or r[11]]
    return language, pairs, often, size, by_size, words, by_words, kept


def _measure(text: str) -> tuple[str, float, float, list[tuple], bool]:
    """``measure``, and whether the page's words recur as in a list; a line that wasn't asked whether it is an entry has None there."""
    low = text.lower()
    lines: list[list] = [["", 0]]  # text without links, characters of links
    at = 0
    if _may_link(low):
        for m in _LINK.finditer(low):  # links stay whole: their inside isn't cut into lines
            for k, part in enumerate(_lines(low[at : m.start()])):
                if k:
                    lines.append(["", 0])
                lines[-1][0] += part
            lines[-1][1] += m.end() - m.start()
            at = m.end()
    for k, part in enumerate(_lines(low[at:])):
        if k:
            lines.append(["", 0])
        lines[-1][0] += part
    kept = [x for x in lines if x[1] or x[0].strip()]
    find = (_WORD if _MARK.search(low) else _PLAIN_WORD).findall
    seen: set = set()
    line_sentences, line_parts, again = [], [], []
    copies: Counter = Counter()
    fresh: list[list[str]] = []
    for plain, linked in kept:
        if "<" in plain:
            plain = _TAG.sub(" ", plain)
        if "_" in plain:
            plain = plain.replace("_", " ")
        if (":" in plain or "[" in plain) and (m := _LABEL.match(plain)):
            plain = plain[m.end() :]
        again.append(plain in seen and not linked)
        seen.add(plain)
        parts = _SENTENCE.split(plain)
        found = list(map(find, parts))
        if not all(found):
            parts = [p for p, w in zip(parts, found, strict=True) if w]
            found = list(filter(None, found))
        sentences = found
        line_parts.append(parts)
        line_sentences.append(sentences)
        for words in sentences:
            if (key := tuple(words)) not in seen:
                seen.add(key)
                fresh.append(words)
            else:
                copies[key] += 1
    singles = Counter(chain.from_iterable(fresh))
    language = _language(singles)
    known = _SETS.get(language, frozenset())
    singles = {w: n for w, n in singles.items() if w not in known}
    copied = [0.0] * len(kept)
    if copies and max(copies.values()) >= 2:  # by the text itself, as numbers aren't words: 'Kapitel 1.' and 'Kapitel 2.' are no copies
        line_parts = [[p.strip() for p in parts] for parts in line_parts]
        times = Counter(chain.from_iterable(line_parts))
        for k, (parts, sentences) in enumerate(zip(line_parts, line_sentences, strict=True)):
            if many := sum(len(w) for p, w in zip(parts, sentences, strict=True) if times[p] >= 3 and _lacks(w)):
                copied[k] = many / sum(map(len, sentences))
    total = max(1, sum(singles.values()))
    # only words that recur can be in pairs that do
    recurring = {w for w, n in singles.items() if n >= 3}
    often = {w for w in recurring if singles[w] * 50 >= total}
    pairs = Counter(p for words in fresh if not recurring.isdisjoint(words) for p in zip(words, words[1:]) if p[0] in recurring and p[1] in recurring) if recurring else Counter()
    double = {p for p, n in pairs.items() if n >= 3}
    starts = {a for a, _ in double}
    glued, marked = language in FUNCTION_SIGNS, _MARKED.search(low) is not None
    rows, all_hits, all_often, count = [], 0, 0, 0
    for x, sentences, repeated, copy in zip(kept, line_sentences, again, copied, strict=True):
        words = sentences[0] if len(sentences) == 1 else list(chain.from_iterable(sentences))
        n, hits = len(words), 0
        many = sum(map(often.__contains__, words)) if often else 0
        if double and not starts.isdisjoint(words):
            for within in sentences:
                if not starts.isdisjoint(within) and True in (flags := list(map(double.__contains__, zip(within, within[1:])))):
                    hits += sum(map(or_, [False, *flags], [*flags, False]))
        function = 0.0
        if n:
            if glued:
                function = _glued_share(words, language)
            elif known:
                function = sum(map(known.__contains__, words)) / n
        size = len(x[0].strip()) + x[1]
        d = max(1, n)
        if function > MOST_LOW:  # the marks of lists are asked for in lines without function words alone
            rows.append((size, x[1] / size, function, hits / d, many / d, 0.0, 0.0, n, repeated, None, True, copy))
        else:
            marks = len(_PRODUCT.findall(x[0])) if marked and _MARKED.search(x[0]) else 0
            ended = (end := x[0].rstrip(_CLOSERS)[-1:]) != "" and end in _ENDS
            # separators count where words recur, and being an entry where anything else speaks for junk
            seps = len(_SEPARATOR.findall(x[0])) / d if many else 0.0
            entry = _is_entry(x) if not ended or copy or many > 0.34 * d or hits > 0.29 * d else None
            rows.append((size, x[1] / size, function, hits / d, many / d, seps, marks / d, n, repeated, entry, ended, copy))
        all_hits, all_often, count = all_hits + hits, all_often + many, count + n
    # a page whose words recur may be a list, and then all its lines are asked
    list_like = all_often >= (LEAST_OFTEN - 0.001) * max(1, count)
    if list_like:
        rows = [r if r[9] is not None else (*r[:9], _is_entry(x), *r[10:]) for r, x in zip(rows, kept, strict=True)]
    return language, all_hits / max(1, count), all_often / max(1, count), rows, list_like


_LINE_TYPE = pa.struct([("size", pa.int32()), ("link", pa.float32()), ("fun", pa.float32()), ("pairs", pa.float32()), ("often", pa.float32()), ("seps", pa.float32()), ("marks", pa.float32()), ("words", pa.int32()), ("again", pa.bool_()), ("entry", pa.bool_()), ("ended", pa.bool_()), ("copied", pa.float32())])


_SUMS = [("pairs", pa.float32()), ("often", pa.float32()), ("size", pa.int64()), ("by_size", pa.float64()), ("words", pa.int64()), ("by_words", pa.float64())]


def measure_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, language, pairs, often, size, by_size, words, by_words, lines) of the documents that aren't blank; ``copy`` is the same
    for the same text."""
    source = documents.select(F.col(key).alias("k"), F.xxhash64(text).alias("copy"), F.col(text).alias("t")).where("k is not null and t is not null and trim(t) != ''")
    names = ["k", "copy", "language", *[n for n, _ in _SUMS], "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [summed(t) for t in batch.column(2).to_pylist()]
            flat = [r for x in got for r in x[-1]]
            offsets = [0]
            for x in got:
                offsets.append(offsets[-1] + len(x[-1]))
            columns = list(zip(*flat, strict=True)) if flat else [[] for _ in _LINE_TYPE]
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINE_TYPE, strict=True)], fields=list(_LINE_TYPE))
            rest = [pa.array([x[k] for x in got], t) for k, t in enumerate([pa.string(), *[t for _, t in _SUMS]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], names)

    kind = source.schema["k"].dataType.simpleString()
    line = "size:int,link:float,fun:float,pairs:float,often:float,seps:float,marks:float,words:int,again:boolean,entry:boolean,ended:boolean,copied:float"
    schema = f"k {kind}, copy bigint, language string, pairs float, often float, size bigint, by_size double, words bigint, by_words double, lines array<struct<{line}>>"
    return source.mapInArrow(run, schema).withColumnRenamed("k", key)


def _sum(lines: str, value) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda a, x: a + value(x))


def calibrate(pages: DataFrame) -> dict[str, dict[str, float]]:
    """Thresholds of each language from its distinct texts: {'low': function share, 'pairs': ..., 'often': ...}.

    Stuffed pages move the 90 % shares as soon as they are a tenth of a language, so these count only as far as they stay near
    the median, which takes half of the texts to move, and below a fixed share, which nothing moves.
    """
    share = F.col("by_size") / F.greatest(F.col("size"), F.lit(1))
    texts = pages.select("language", "copy", share.alias("fun"), "pairs", "often").dropDuplicates(["language", "copy"])
    rows = texts.groupBy("language").agg(*[F.percentile_approx(c, [0.5, 0.9], 10000).alias(c) for c in ("fun", "pairs", "often")]).collect()  # at most one row for each of LANGUAGES
    out = {name: {"low": 0.15, "pairs": 0.3, "often": 0.5} for name in LANGUAGES}
    for r in rows:
        glued = r.language in FUNCTION_SIGNS
        more = MARGIN_OFTEN if glued else 0.0
        out[r.language] = {
            "low": max(LEAST_LOW, LOW * r.fun[0]),
            "pairs": max(LEAST_PAIRS, min(r.pairs[1] + MARGIN_PAIRS, r.pairs[0] + SPREAD_PAIRS, MOST_PAIRS)),
            "often": max(LEAST_OFTEN_GLUED if glued else LEAST_OFTEN, min(r.often[1] + MARGIN_OFTEN + more, r.often[0] + SPREAD_OFTEN + more, MOST_OFTEN)),
        }
    out["other"] = {"low": 0.01, "pairs": 0.5, "often": 2.0}  # no function word at all: nothing to calibrate by
    return out


#: Factor of a language's median share of function words below which a line lacks them; margins over the 90 % shares.
LOW, MARGIN_PAIRS, MARGIN_OFTEN = MOST_LOW, 0.15, 0.15
#: What a threshold lies above the median share at most, and the highest thresholds.
SPREAD_PAIRS, SPREAD_OFTEN, MOST_PAIRS, MOST_OFTEN = 0.35, 0.5, 0.5, 0.75
LEAST_LOW, LEAST_PAIRS, LEAST_OFTEN, LEAST_OFTEN_GLUED, LEAST_WORDS = 0.1, 0.2, 0.3, 0.6, 8


def junk_share(limits: dict[str, dict[str, float]]) -> Column:
    """Share of junk in a page of ``measure_pages``, by the thresholds of its language."""
    of = lambda name: F.coalesce(F.create_map(*[F.lit(x) for lang, t in sorted(limits.items()) for x in (lang, t[name])])[F.col("language")], F.lit(limits["other"][name]))
    low = of("low")
    words = F.col("words")
    # a text that as a whole has next to no function words: captions and keywords, a stray word may fit some language
    bare = (F.col("language") == "other") | (F.col("by_words") / F.greatest(words, F.lit(1)) < low / 2) & (words >= 12)

    # a line needs no less than a whole text of its language
    line_often = F.when(F.col("language") == "other", 0.35).otherwise(F.greatest(F.lit(0.35), of("often")))
    line_pairs = F.when(F.col("language") == "other", 0.3).otherwise(F.greatest(F.lit(0.3), of("pairs")))

    def is_junk(x: Column) -> Column:
        lacks = x["fun"] < low
        recurs = (x["often"] >= line_often) | (x["pairs"] >= line_pairs)
        listed = ~x["ended"] & ((x["seps"] >= 0.25) & (x["often"] > 0) | x["again"] | bare | ((x["words"] >= 12) & (x["fun"] < low / 3)))
        worded = (words >= LEAST_WORDS) & lacks & ((x["marks"] >= 0.08) | (~(x["entry"] & (x["pairs"] < 0.5)) & (recurs | listed)))
        return (x["link"] >= 0.5) | worded

    total = F.greatest(F.col("size").cast("double"), F.lit(1.0))
    # copies without function words are keywords, ended or not and whatever stands beside them in the line; refrains have function words
    copied = lambda x: F.when((words >= LEAST_WORDS) & ~x["entry"], x["copied"].cast("double")).otherwise(0.0)
    lines = _sum("lines", lambda x: x["size"] * F.when(is_junk(x), F.lit(1.0)).otherwise(copied(x))) / total
    listed = _sum("lines", lambda x: F.when(x["entry"] & (x["pairs"] < 0.5), x["size"].cast("double")).otherwise(0.0)) / total
    strewn = (words >= LEAST_WORDS) & ((F.col("pairs") >= of("pairs")) | ((F.col("often") >= of("often")) & (listed < 0.5)))
    return F.when(strewn, F.greatest(lines, F.lit(1.0))).otherwise(lines)


def stuffed_pages(documents: DataFrame, share: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, junk_share) of the documents that consist of junk for the greater part."""
    ensure_checkpoint_dir(documents.sparkSession)
    pages = measure_pages(documents, key, text).checkpoint()
    return pages.select(key, "language", junk_share(calibrate(pages)).alias("junk_share")).where(F.col("junk_share") >= share).dropDuplicates([key])

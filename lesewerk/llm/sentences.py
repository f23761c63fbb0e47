"""Sentence units of texts in any script.

Method: candidates come from the standard Sentence_Break character properties (STerm and ATerm cover the terminators of all
scripts); a candidate takes its closing quotation marks and brackets with it and is then kept or dropped by what stands on
both sides: lower case or a continuing mark after it, abbreviations, initials, ordinals and numbers before a full stop, and
words that announce a quotation. Blank lines always end a unit; Thai has no terminators, there spaces do it.

Defined cases: null, empty and blank texts have no unit. Undisplayed characters (zero-width, soft hyphens and the like) are
looked through; at a unit's end they belong to that unit. A heading is one unit (but for blank lines in it).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_property(pattern: str) -> str:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    return "".join(regex.findall(pattern, every))


#: Characters of the Sentence_Break classes STerm and ATerm, and the dots of omission, which have no class of their own.
TERMINAL = _with_property(r"[\p{SB=STerm}\p{SB=ATerm}]") + "…‥"
#: Terminators that need no white space after them: all but those that Latin, Greek and Cyrillic texts share.
UNSPACED = frozenset(TERMINAL) - frozenset(".!?…‥․﹒．‼‽⁇⁈⁉")
#: What a reader doesn't see: Default_Ignorable_Code_Point.
IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
OPENING = frozenset("\"„“”»«›‹‚‘’'([{「『【《〈（［｛〔〖¿¡‟‛")
QUOTES = frozenset("\"„“”»«›‹‚‘’'「」『』《》〈〉｢｣＂")
CLOSING = frozenset("\"“”»«›‹’‘')]}」』】》〉）］｝〕〗｣＂")
BRACKETS = frozenset(")]}】）］｝〕〗」』》〉｣")
CONTINUING = frozenset(",;:،؛、，；：)]}）］｝")
DASHES = "—–-―‒"

# Abbreviations and words around numbers, by language. Lower case.
#: Never the end of a sentence: something has to follow.
NEVER = frozenset(
    # German
    "dr prof hr hrn fr frl ing dipl vgl bzw ca evtl ggf inkl exkl sog zzgl insb bsp bspw geb gest hl jg tel usf z d "
    # English
    "mr mrs ms messrs vs approx cf viz incl esp "
    # French, Spanish, Italian
    "mme mmes mlle mgr env av sr sra srta srs dra ud uds ej aprox pág "
    # Russian, Hindi, Arabic
    "проф акад им ул тов г-н г-жа डॉ श्री पं د أ".split()
)
#: The same, but ordinary words or names where they are written in the other case: titles in capitals, the rest in small letters.
NEVER_CAPITAL = frozenset("mag st gen col sen rep hon capt sgt gov lt rev mm".split())
NEVER_SMALL = frozenset("max min med phil jur rer nat".split())
#: Abbreviations only behind these words.
NEVER_BEHIND = {"al": ("et",), "ex": ("par", "p", "z")}
#: Words that begin a sentence and are no name: behind a title, initial or ordinal they tell that the sentence ended with it.
STARTERS = frozenset(
    # German
    "er sie es ich du wir ihr man der die das den dem ein eine dann da dort danach doch aber und oder wenn als weil jetzt nun hier heute morgen gestern alle niemand jeder dieser diese dieses "
    # English
    "he she it they we i you the this that these those then there but and if when after before his their my our its everyone nobody what who why how now today "
    # French, Spanish, Italian
    "il elle nous vous ils elles je mais puis alors ella ellos pero entonces luego cuando ma poi quando "
    # Russian
    "он она они мы но потом это тогда".split()
)
#: Stand before a number; before anything else they may end a sentence.
NUMBERED = frozenset("nr nrn no nos art abs abb bd bde kap tab fig vol ch sec str s p pp núm стр рис гл jan feb mär mrz mar apr jun jul aug sep sept okt oct nov dez dec".split())
#: Written with inner points, and may end a sentence.
DOTTED_END = frozenset("p.m a.m u.a u.ä u.ae u.v.m u.a.m u.s.w u.dgl i.d.r n.chr v.chr u.s u.k d.c j.-c т.д т.п".split())
#: The same written with spaces, as the end of the text before a point.
SPACED_END = re.compile(r"(?:^|\s)(?:u\. +[aäÄ]|u\. *a\. *m|u\. *s\. *w|u\. *v\. *m|i\. *d\. *R|n\. *Chr|v\. *Chr|v\. *H|J\. *-C|т\. *[дп]|p\. *m|a\. *m)$")
#: A single capital or a number after one of these is a name, not an initial or an ordinal.
LABELS = frozenset("plan klasse raum typ punkt gruppe gleis block stufe saal modell version vitamin skala teil zone halle reihe tor haus station note variante option team room class type group level jahr genau seite zimmer kapitel nummer".split())
#: Words before an ordinal number.
ORDINAL_BEFORE = frozenset("der die das den dem des ein eine einen einem einer eines am im zum zur vom beim ins ans bis seit ab jeder jede jedes jeden jedem dieser diese dieses diesen diesem".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb apr jun jul aug sep sept okt nov dez".split())
#: Reporting verbs of languages without case, which follow a quotation in its sentence.
SAID_ZH = re.compile(r"[^。！？!?“”「」『』：:\s]{0,12}?[说說道问問喊叫答嚷讲曰]")
SAID_JA = re.compile(r"[とっ]")
SAID_HI = re.compile(r"[^।॥?!“”\"]*?(?:कहा|पूछा|बोल|चिल्ला|बताया|उत्तर दिया|जवाब दिया)")
SAID_AR = re.compile(r"\s*(?:قال|سأل|صاح|همس|أجاب|رد|هتف|صرخ)")
#: Letters of other scripts that look like Latin ones, for reading abbreviations.
LOOKALIKE = str.maketrans("АВЕЗКМНОРСТУХаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѕЅІЈ", "ABE3KMHOPCTYXaeopcyxsijABEZHIKMNOPTYXosSIJ")

_TERM = re.compile("[" + re.escape(TERMINAL) + "]+")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_OTHER_SPACE = re.compile(r"[^\S ]")
_THAI = re.compile(r"[฀-๿]")
_SPACES = re.compile(r" +")
_LINE_ENDS = re.compile(r"\r(?!\n)|[\x85  ]")


def _word_start(p: str, at: int) -> int:
    """Begin of the word that ends at ``at``; of a longer one the last 80 characters count, which no abbreviation has."""
    least = max(0, at - 80)
    return max(p.rfind(" ", least, at) + 1, least)


def _word_before(p: str, at: int) -> str:
    return p[_word_start(p, at) : at]


def _starts_sentence(p: str, after: int) -> bool:
    """Whether the word at ``after`` is one that begins sentences; a capital with a point is an initial."""
    e = after
    while e < len(p) and e - after < 12 and p[e].isalpha():
        e += 1
    return p[after:e].lower() in STARTERS and not (e - after == 1 and p[e : e + 1] == ".")


def _previous_word(p: str, start: int) -> str:
    """The word before the one that begins at ``start``, over any number of spaces."""
    while start and p[start - 1] == " ":
        start -= 1
    return _word_before(p, start)


def _stays(p: str, dot: int, after: int, start: int) -> bool:
    """Whether the single full stop at ``dot`` belongs to its word. The text goes on at ``after``; the unit began at ``start``."""
    s = _word_start(p, dot)
    word = p[s:dot].strip("\"„“”»«›‹‚‘’'([{（「『¿¡—–")
    if not word:
        return False
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
        word = latin if (latin := word.translate(LOOKALIKE)).isascii() else word
    low, nxt = word.lower(), p[after]
    if low[-1].isdigit():
        if not low.isdigit():
            return False
        if s <= start:
            return True  # the number of a list entry
        before = _previous_word(p, s).strip("\"„“”»«›‹‚‘’'([{.").lower()
        if before in ORDINAL_BEFORE:
            return len(low) <= 3 and not _starts_sentence(p, after)
        e = after
        while e < len(p) and p[e].isalpha():
            e += 1
        return len(low) <= 2 and before not in LABELS and p[after:e].lower() in MONTHS
    if len(word) == 1:
        if not word.isalpha():
            return False
        if SPACED_END.search(p, max(0, dot - 16), dot) or word.lower() == "ä" and _previous_word(p, s) == "u.":
            return False
        before = _previous_word(p, s).strip("\"„“”»«›‹‚‘’'([{") if s > start else ""
        if word.isupper():
            return before.lower() not in LABELS and not (before and _starts_sentence(p, after))
        return not (low == "г" and before[-1:].isdigit() and not nxt.isdigit())
    if "." in word:
        if low in DOTTED_END:  # in capitals it is initials, but for the hours of a day
            return word.isupper() and not (low[-2:] == ".m" and _previous_word(p, s)[-1:].isdigit() or s > start and _starts_sentence(p, after))
        last = low.rpartition(".")[2]
        if word.isupper() and s > start and _starts_sentence(p, after):
            return False
        return len(last) < 2 or last in NEVER or last in NEVER_CAPITAL or last in NEVER_SMALL
    if low in NUMBERED:
        return nxt.isdigit()
    if low == "chr" or low == "etc" or low == "usw":
        return False
    if low in NEVER_CAPITAL:
        return word[0].isupper() and not _starts_sentence(p, after)
    if low in NEVER_SMALL:
        return (word.islower() or s <= start) and not _starts_sentence(p, after)
    if low in NEVER_BEHIND:
        return _previous_word(p, s).strip(".(\"„«").lower() in NEVER_BEHIND[low]
    return low in NEVER


def _french(p: str, left: str, right: str, start: int, at: int) -> bool:
    """Whether a quotation in the style «...» is open at ``at``; in the style »...« the first mark points the other way."""
    a, b = p.find(left, start, at), p.find(right, start, at)
    return a >= 0 and (b < 0 or a < b) and p.count(left, start, at) > p.count(right, start, at)


def _reported(p: str, at: int, start: int) -> bool:
    """Whether the words after a quotation that ended at ``at`` belong to its sentence, in scripts without case."""
    rest = p[at : at + 60]
    if SAID_JA.match(rest):
        return True
    while start < at and p[start] == " ":
        start += 1
    if p[start] not in QUOTES:
        return False  # the quotation was announced before
    return bool(SAID_ZH.match(rest) or SAID_AR.match(rest) or SAID_HI.match(rest))


def _paragraph(p: str, lower: bool) -> list[int]:
    """Ends of the units of one paragraph, its own end last. ``p`` has no white space at its ends."""
    out: list[int] = []
    n, start = len(p), 0
    thai = _thai_ends(p) if _THAI.search(p) else []
    for m in _TERM.finditer(p):
        first, i = m.span()
        if i >= n:
            break
        if i < start:
            continue
        run, inside = m.group(), i
        last = run[-1]
        while i < n:
            c = p[i]
            if c in CLOSING:
                if c not in BRACKETS and i + 1 < n and (p[i + 1].isalnum() or p[i + 1] in OPENING):
                    seen = p.count(c, start, i)
                    if c == '"' or c == "'":
                        if not seen % 2:
                            break
                    elif c in "“”" and not (p.count("„", start, i) + p.count("“", start, i) + p.count("”", start, i)) % 2:
                        break
                    elif c in "»«" and not (p.count("»", start, i) + p.count("«", start, i)) % 2:
                        break
                    elif c in "›‹‘’" and not (p.count("›", start, i) + p.count("‹", start, i) + p.count("‚", start, i) + p.count("‘", start, i)) % 2:
                        break
                i += 1
            elif c == " " and i + 1 < n and p[i + 1] in "»›" and _french(p, "«‹"["»›".index(p[i + 1])], p[i + 1], start, i):
                i += 2
            else:
                break
        if i >= n:
            break
        j = i
        while p[j] == " ":
            j += 1
        nxt, quoted = p[j], i > inside
        if nxt in TERMINAL or nxt in CONTINUING:
            continue
        if nxt.islower() and not lower:
            continue
        if nxt in DASHES:
            k = j
            while k < n and (p[k] in DASHES or p[k] == " "):
                k += 1
            if j == i or k < n and p[k].islower():
                continue
        cased = nxt.isupper() or nxt.istitle()
        opening = nxt in OPENING
        omission = last in "…‥" or run.endswith("..")
        if opening and nxt == "(" and j + 1 < n and p[j + 1].islower():
            continue
        if last in UNSPACED:
            if quoted and not cased and not opening and _reported(p, i, start):
                continue
        elif j == i:  # white space may be missing between two units
            if not (cased or opening):
                if quoted and nxt.isalpha() and not nxt.islower():
                    if _reported(p, i, start):
                        continue
                elif not (last in "!?" and nxt.isalpha() and not nxt.islower()):
                    continue
            if run == "." and not quoted:
                s = _word_before(p, first).lstrip("\"„“”»«›‹‚‘’'(")
                if len(s) < 2 or "." in s or "/" in s or "@" in s or _stays(p, first, j, start):
                    continue
        elif omission:
            if not (cased or opening or nxt.isdigit() or lower and not nxt.isalnum()):
                continue
        elif run == "." and not quoted:
            if _stays(p, first, j, start):
                continue
        elif quoted and not cased and nxt.isalpha():
            if nxt.islower() or _reported(p, i, start):
                continue
        out.append(i)
        start = j
    if thai:
        out = sorted({*out, *thai})
    if not out or out[-1] != n:
        out.append(n)
    return out


def _thai_ends(p: str) -> list[int]:
    out = []
    for m in _SPACES.finditer(p):
        a, b = p[m.start() - 1], p[m.end()]
        if not a.isnumeric() and not b.isnumeric() and ("฀" <= a <= "๿" or "฀" <= b <= "๿") and a not in OPENING - CLOSING and b not in CONTINUING:
            out.append(m.start())
    return out


def unit_ends(text: str | None, heading: bool = False) -> list[int]:
    """Ends of the sentence units of a text, in code points from its start, in order."""
    if not text or text.isspace():
        return []
    clean, back = text, None
    if not text.isascii() and IGNORABLE.search(text):
        keep = np.ones(len(text) + 1, dtype=bool)
        parts, at = [], 0
        for m in IGNORABLE.finditer(text):
            parts.append(text[at : m.start()])
            keep[m.start() : m.end()] = False
            at = m.end()
        clean = "".join([*parts, text[at:]])
        where = np.flatnonzero(keep)  # of each kept character, and of the text's end
        back = where[1:].tolist()  # a unit reaches to the next kept character
        if not clean or clean.isspace():
            return [len(text.rstrip())] if text.strip() else []
    if _LINE_ENDS.search(clean):
        clean = _LINE_ENDS.sub("\n", clean)
    lower = clean.islower()
    ends: list[int] = []
    at, n = 0, len(clean)
    while at < n:
        m = _BLANK.search(clean, at)
        stop = m.start() if m else n
        p = clean[at:stop]
        if body := p.strip():
            off = at + len(p) - len(p.lstrip())
            if heading:
                ends.append(off + len(body))
            else:
                if _OTHER_SPACE.search(body):
                    body = _OTHER_SPACE.sub(" ", body)
                ends += [off + e for e in _paragraph(body, lower)]
        at = m.end() if m else n
    if back is not None:
        # white space before an undisplayed character isn't part of a unit that ends before that white space
        ends = [back[e - 1] for e in ends]
        ends = [e if e == len(text) or not text[e - 1].isspace() else len(text[:e].rstrip()) for e in ends]
    return ends


def split_units(text: str | None, heading: bool = False) -> list[str]:
    """The units as strings; with the white space between them left out they are the text."""
    out, at = [], 0
    for e in unit_ends(text, heading):
        out.append(text[at:e].lstrip())
        at = e
    return out


def sentence_units(df: DataFrame, with_text: bool = False) -> DataFrame:
    """Units of (item_kind, item_id, is_heading, text) rows as (item_kind, item_id, end_pos), with ``with_text`` also
    (unit_no, start_pos, unit). A row is worked on alone, so there is no shuffle; give distinct rows."""
    source = df.select("item_kind", "item_id", F.coalesce("is_heading", F.lit(False)).alias("is_heading"), "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            found = [unit_ends(t, h) for t, h in zip(texts, batch.column(2).to_pylist(), strict=True)]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            rows = pa.array(np.repeat(np.arange(len(found)), counts))
            ends = [e for x in found for e in x]
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ends, pa.int64())]
            names = ["item_kind", "item_id", "end_pos"]
            if with_text:
                no, begin, units = [], [], []
                for t, x in zip(texts, found, strict=True):
                    at = 0
                    for k, e in enumerate(x):
                        unit = t[at:e].lstrip()
                        no.append(k)
                        begin.append(e - len(unit))
                        units.append(unit)
                        at = e
                columns += [pa.array(no, pa.int32()), pa.array(begin, pa.int64()), pa.array(units, pa.string())]
                names += ["unit_no", "start_pos", "unit"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "item_kind string, item_id bigint, end_pos bigint" + (", unit_no int, start_pos bigint, unit string" if with_text else "")
    return source.mapInArrow(run, schema)

"""One form for texts that look the same but differ in their characters.

Method: compatibility normalization and deletion of ignorable characters bring most variants together; what is left are
letters of one script that look like letters of another. Each token is then a lattice: every look-alike character stands for
all members of its class. A Viterbi search takes the path with the best character bigram score, in which a change of script
inside a token costs more than any bigram can win. The bigrams are counted over all given rows.

The letter that was observed has no weight of its own: any weight would let two variants of one token end in different forms.
So the search sees what all variants share, the classes of a token and the script that the whole text's unmistakable letters
belong to, and two texts come out equal exactly if their displayed characters are the same; the counts choose the spelling.

Classes hold letters of identical shape alone. Letters that are merely alike (Greek alpha, rho, tau, kappa; Latin alpha) stay
apart, as a reader can tell them. Letters above U+0590 have no counts; there the script decides.

Kept apart: case, accents, raised and lowered digits, fractions, circled signs and punctuation that looks different, and the
number of spaces. Made equal: kinds of space, width, coding of accents and of joined letters, code blocks of identically
shaped signs. Null stays null, the empty string stays empty.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lesewerk.llm.common import small_rows

# Classes of letters that have the same shape, Latin member first, then those of other scripts.
CLASSES = """
aа cсϲⲥ dԁ eе hһհ iі jјϳյ nո oоοօⲟ pрⲣ qԛզ sѕ uս vν wԝ xх yу gɡց əә
AАΑᎪⲀꓮ BВΒᏴꓐ CСϹᏟⲤꓚ DᎠꓓ EЕΕᎬꓰ FϜꓝ GԌᏀꓖ HНΗᎻⲎꓧ IІΙӀⲒꓲ JЈͿᎫꓙ KКΚᏦⲔꓗ LᏞꓡ MМΜᎷⲘꓟ NΝⲚꓠ OОΟՕⲞꓳ PРΡᏢⲢꓑ QԚ RᎡꓣ SЅՏᏚꓢ TТΤᎢⲦꓔ UՍꓴ VѴᏙꓦ WԜᎳꓪ XХΧⲬꓫ YҮΥꓬ ZΖᏃꓜ ƏӘ
ГΓ ПΠ ФΦ
""".split()
#: Signs of one shape: the first is kept.
SIGNS = """
-‐‑ ·‧∙⋅・ ;; :꞉ !ǃ ’ʼ へヘ べベ ぺペ
""".split()
#: Compatibility decompositions that look like what they stand for.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>", "<small>", "<vertical>")
#: Compatibility characters that look different all the same: long s, spacing accents, and letters that have a class above.
DIFFERENT = frozenset("ſ¨¯´¸˘˙˚˛˜˝͵ͺ΄‗‾⁗″‴ϐϑϒϕϖϰϱϴϵ") | frozenset("".join(CLASSES)) | frozenset("".join(SIGNS))
#: A change of script inside a token, a character outside the text's script, and the weight of an unseen bigram.
SWITCH, FOREIGN, SMOOTH = 1e6, 2.0, 0.5

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_SPACE = regex.compile(r"[^\S\n ]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_SCRIPTS = {"LATIN": 0, "CYRILLIC": 1, "GREEK": 2}
#: Letters whose bigrams are counted: all below this code point.
LETTERS = 0x590


@lru_cache(maxsize=None)
def script(c: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Greek, 3 other letters, -1 no letter."""
    if not c.isalpha():
        return -1
    return _SCRIPTS.get(unicodedata.name(c, "").partition(" ")[0], 3)


def _compatible() -> dict[int, str]:
    out = {}
    for k in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]:
        c = chr(k)
        d = unicodedata.decomposition(c)
        if d.startswith(SAME_SHAPE) and c not in DIFFERENT:
            full = unicodedata.normalize("NFKC", c)
            if not (full.startswith(" ") and len(full) > 1):
                out[k] = full
    return out


_TO_COMMON = _compatible() | {ord(c): s[0] for s in SIGNS for c in s[1:]}
_CLASS = {c: s for s in CLASSES for c in s}
#: The members of Latin, Cyrillic and Greek, which every token's lattice has.
_COMMON = {c: "".join(m for m in t if script(m) != 3) for t in CLASSES for c in t}
_MEMBERS = frozenset(c for t in CLASSES for c in t[1:])
_UNSTABLE = regex.compile(r"[\p{M}\p{Default_Ignorable_Code_Point}\p{Script=Cyrillic}\p{Script=Greek}\u1100-\u11ff]|[^\S\n ]")


class _Plain(dict):
    """Character -> whether it stands for itself wherever it occurs: no variant of another one, nothing that combines."""

    def __missing__(self, c: str) -> bool:
        self[c] = not (c in _MEMBERS or ord(c) in _TO_COMMON or _UNSTABLE.match(c) or unicodedata.normalize("NFC", c) != c)
        return self[c]


_plain = _Plain().__getitem__


def flatten(text: str) -> str:
    """Compatibility normalization, deletion of ignorable characters and one kind of space; look-alike letters stay."""
    text = _IGNORABLE.sub("", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = unicodedata.normalize("NFD", text).translate(_TO_COMMON)
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text))


class Model:
    """Bigram scores of letters: log of the share that the second letter has after the first one."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        after: dict[int, int] = {}
        for (a, _), n in counts.items():
            after[a] = after.get(a, 0) + n
        self.counts, self.after = counts, after
        self.known: dict[tuple[str, int], str] = {}
        self.scores: dict[tuple[str, str], float] = {}

    def score(self, a: str, b: str) -> float:
        if (got := self.scores.get((a, b))) is not None:
            return got
        if len(self.scores) >= 1 << 18:
            self.scores.clear()
        n = self.counts.get((ord(a) if a else 0, ord(b)), 0)
        self.scores[a, b] = found = math.log((n + SMOOTH) / (self.after.get(ord(a) if a else 0, 0) + SMOOTH * LETTERS))
        return found

    def spell(self, token: str, main: int) -> str:
        """The best path through a token's lattice."""
        if (got := self.known.get((token, main))) is not None:
            return got
        # a state is (score, script so far, last letter, chain of the characters back to the first)
        states: list[tuple[float, int, str, tuple | None]] = [(0.0, -1, "", None)]
        flat = unicodedata.normalize("NFD", token)
        # other scripts come into question where an unmistakable letter of the token is one of theirs
        of = _CLASS if any(c not in _CLASS and script(c) == 3 for c in flat) else _COMMON
        for c in flat:
            if script(c) < 0 and c not in _CLASS:  # marks and digits tell nothing of the script: every state goes on
                states = [(score, before, last, (c, chain)) for score, before, last, chain in states]
                continue
            nxt = []
            for member in of.get(c, c):
                s = script(member)
                ways = [
                    (score + self.score(last, member) - (SWITCH if before not in (-1, s) else 0) - (FOREIGN if s != main else 0), -k, s, member, (member, chain))
                    for k, (score, before, last, chain) in enumerate(states)
                ]
                score, _, s, last, chain = max(ways, key=lambda w: w[:2])  # of equal ones the first
                nxt.append((score, s, last, chain))
            states = nxt
        chain, letters = max(states, key=lambda w: w[0])[3], []
        while chain:
            letters.append(chain[0])
            chain = chain[1]
        best = unicodedata.normalize("NFC", "".join(reversed(letters)))
        if len(self.known) >= 1 << 18:
            self.known.clear()
        if len(token) <= 64:
            self.known[token, main] = best
        return best

    def canonical(self, text: str | None) -> str | None:
        if not text or (text.isascii() and "\r" not in text and "\t" not in text) or all(map(_plain, set(text))):
            return text
        text = flatten(text)
        if text.isascii():
            return text
        # unmistakable letters vote for the script of the whole text
        votes = [0, 0, 0]
        for c in _MARKED.findall(unicodedata.normalize("NFD", text)):
            votes[script(c)] += 1
        votes[0] = len(_LATIN.findall(text))
        main = votes.index(max(votes))
        return _WORD.sub(lambda m: self.spell(m.group(), main) if not _FIXED.fullmatch(m.group()) else m.group(), text)


_LETTERS = "".join(c for t in CLASSES for c in t)
#: Letters without a look-alike that only Cyrillic or Greek has, and such letters of Latin; tokens of which every letter stands for itself.
_MARKED = regex.compile(rf"[[[\p{{Script=Cyrillic}}\p{{Script=Greek}}]&&\p{{L}}]--[{_LETTERS}]]|[ГΓПΠФΦ]", regex.VERSION1)
_LATIN = regex.compile(rf"[[\p{{Script=Latin}}&&\p{{L}}]--[{_LETTERS}]]", regex.VERSION1)
_FIXED = regex.compile(rf"[[\p{{L}}\p{{N}}]--[{_LETTERS}\u00c0-\u1fff]]+", regex.VERSION1)


def count_bigrams(df: DataFrame, *texts: str) -> dict[tuple[int, int], int]:
    """Counts of letter bigrams over all rows of the text columns, word beginnings as (0, letter). Each batch sends its sums only;
    their number is bounded by the square of ``LETTERS``, whatever the number of rows."""
    source = df.select(*[F.col(t) for t in texts])
    letter = np.array([k if chr(k).isalpha() else 0 for k in range(LETTERS)] + [0], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, dtype=np.int64)
        for batch in batches:
            for column in batch.columns:
                for start in range(0, len(column), 2000):
                    s = "\n" + "\n".join(x for x in column.slice(start, 2000).to_pylist() if x)
                    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                    codes = letter[np.minimum(points, LETTERS)]
                    total += np.bincount(codes[:-1] * LETTERS + codes[1:], minlength=LETTERS * LETTERS) if len(codes) > 1 else 0
        at = np.flatnonzero(total)
        at = at[at % LETTERS > 0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = small_rows(source.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), LETTERS * LETTERS, "letter pairs")
    return {(r.pair // LETTERS, r.pair % LETTERS): r.n for r in rows}


def canonical_texts(df: DataFrame, key: str, *texts: str, counts: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """(key, <text>_form ...) of each row. ``counts`` are those of ``count_bigrams`` over the corpus; by default over ``df`` itself."""
    counts = count_bigrams(df, *texts) if counts is None else counts
    shared = df.sparkSession.sparkContext.broadcast(counts)
    source = df.select(F.col(key).alias("k"), *[F.col(t).cast("string").alias(f"t{i}") for i, t in enumerate(texts)])
    names = ["k", *[f"f{i}" for i in range(len(texts))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            forms = [pa.array([model.canonical(t) for t in column.to_pylist()], pa.string()) for column in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *forms], names)

    schema = T.StructType([source.schema["k"], *[T.StructField(n, T.StringType()) for n in names[1:]]])
    out = source.mapInArrow(run, schema)
    return out.select(F.col("k").alias(key), *[F.col(f"f{i}").alias(f"{t}_form") for i, t in enumerate(texts)])


def hidden_differences(df: DataFrame, key: str, left: str, right: str, counts: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """Keys of the rows whose two texts are different strings and have one form. Null on either side is no case."""
    rows = df.where(F.col(key).isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    forms = canonical_texts(rows, key, left, right, counts=counts)
    return forms.where(F.col(f"{left}_form") == F.col(f"{right}_form")).select(key).distinct()

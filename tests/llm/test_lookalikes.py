import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lesewerk.llm import lookalikes as l

MODEL = l.Model({(ord("а"), ord("с")): 5, (ord("a"), ord("n")): 9})
SAME = [
    ("Opel", "Орel"), ("fine", "ﬁne"), ("ABC 12", "ＡＢＣ　１２"), ("über", "über"), ("a b", "a b"), ("das", "d​as﻿"), ("Kelvin", "Kelvin"), ("Å", "Å"),
    ("Ω", "Ω"), ("µ", "μ"), ("人", "⼈"), ("später", "sрӓtеr"), ("a-b", "a‑b"), ("Морозов", "Mopoзoв"), ("МОСКВА", "MOCKBA"), ("нос", "нoc"), ("VIII", "Ⅷ"), ("กำ", "กํา"), ("é", "é"), ("Soft", "So­ft"), ("🎙", "🎙️"),
]
DIFFERENT = [("m2", "m²"), ("a", "A"), ("ü", "u"), ("ab", "a b"), ("das", "dass"), ('"a"', "„a“"), ("a.", "a!"), ("½", "1/2"), ("①", "1"), ("rn", "m"), ("ſ", "s"), ("o", "0"), ("ح", "خ"), ("日", "曰")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert MODEL.canonical(a) == MODEL.canonical(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert MODEL.canonical(a) != MODEL.canonical(b)


def test_spelling_keeps_the_script():
    assert MODEL.canonical("Mоpоз и Opel") == "Мороз и Opel"
    assert MODEL.canonical("Er kaufte еin Auto") == "Er kaufte ein Auto"
    assert MODEL.canonical("") == "" and MODEL.canonical(None) is None
    assert MODEL.canonical("HOC") == "HOC" and MODEL.canonical("HOC и стол") == "НОС и стол"
    assert MODEL.canonical("Das Wort ёлка und ëлкa") == "Das Wort ёлка und ёлка"
    assert MODEL.canonical("o" * 200_000 + "ж") == "о" * 200_000 + "ж"
    assert MODEL.canonical("Ένα Aυτοκίνητο") == "Ένα Αυτοκίνητο"


FIRST = {c: t[0] for t in l.CLASSES for c in t}


def classes(text):
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", l.flatten(text)).translate(str.maketrans(FIRST)))


letters = st.text(alphabet=st.sampled_from("aаeеoоοnджлBВΒ HНΗд.̈​1１ﬁäӓ"), max_size=12)


@given(letters, letters)
def test_equal_exactly_if_the_classes_are(a, b):
    assert (MODEL.canonical(a) == MODEL.canonical(b)) == (classes(a) == classes(b))


@given(st.text(max_size=30))
def test_settles(text):
    once = MODEL.canonical(text)
    assert MODEL.canonical(once) == once


@given(st.text(alphabet=st.sampled_from("aаcсeеoорpxх"), min_size=1, max_size=7))
def test_viterbi_against_all_paths(token):
    import itertools

    best = None
    for way in itertools.product(*[l._COMMON[c] for c in token]):
        kinds = [l.script(c) for c in way]
        score = sum(MODEL.score(a, b) for a, b in zip(("", *way), way)) - l.SWITCH * sum(a != b for a, b in zip(kinds, kinds[1:])) - l.FOREIGN * sum(k != 1 for k in kinds)
        if best is None or (score, way) > best:
            best = (score, way)
    got = MODEL.spell(token, 1)
    kinds = [l.script(c) for c in got]
    score = sum(MODEL.score(a, b) for a, b in zip(("", *got), got)) - l.SWITCH * sum(a != b for a, b in zip(kinds, kinds[1:])) - l.FOREIGN * sum(k != 1 for k in kinds)
    assert abs(score - best[0]) < 1e-9


def test_rows(spark):
    rows = [(1, "Opel", "Орel"), (1, "Opel", "Орel"), (2, "a", "a"), (3, None, "x"), (4, "x", None), (5, "ab", "b"), (None, "a", "а"), (6, "", "​"), (7, "x" * 50_000, "х" + "x" * 49_999)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k bigint, n string, a string, n_form int")
    counts = l.count_bigrams(df, "n", "a")
    assert counts[(ord("e"), ord("l"))] == 4 and (0, ord("O")) in counts
    assert sorted(r.k for r in l.hidden_differences(df, "k", "n", "a", counts).collect()) == [1, 6, 7]
    forms = l.canonical_texts(df, "k", "n", "a")
    assert forms.count() == len(rows) and forms.where("k = 3").first().n_form is None
    assert l.hidden_differences(df.limit(0), "k", "n", "a").count() == 0


@pytest.mark.parametrize("a, b, same", [
    ("Ꭺpple", "Apple", True), ("Ꮯat", "Cat", True), ("ⲟk", "ok", True), ("ꓮꓐ", "AB", True), ("օk", "ok", True), ("сор", "cop", True), ("Mосква", "Москва", True),
    ("ɑpple", "apple", False), ("ρaypal", "paypal", False), ("τест", "тест", False), ("Apple", "apple", False), ("Ꭶpple", "Apple", False),
])
def test_scripts(a, b, same):
    assert (MODEL.canonical(a) == MODEL.canonical(b)) == same


def test_words_of_other_scripts_keep_their_letters():
    assert MODEL.canonical("ᎠᎴ") == "ᎠᎴ" and MODEL.canonical("ոչ") == "ոչ"

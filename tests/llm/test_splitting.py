import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lesewerk.llm import splitting as s


def one_by_one(text, most, overlap, fill=0.5):
    """The greedy walk, piece by piece."""
    at, kinds = s.boundaries(text, most - overlap)
    out, b, n = [], 0, len(text)
    while b < n:
        begin = b - overlap if b else 0
        limit = min(begin + most, n)
        least = max(b + max(1, int(fill * (limit - b))), overlap if b == 0 else 0)
        if limit == n:
            cut = n
        else:
            better = [[p for p, k in zip(at, kinds) if k <= kind and least <= p <= limit] for kind in range(4)]
            cut = next((max(x) for x in better if x), None) or max(p for p in at if b < p <= limit)
        out.append((begin, int(cut)))
        b = int(cut)
    return out


def pieces(texts, most, overlap):
    of, a, b = s.cut(texts, np.array(most), np.array(overlap))
    return [[(int(x), int(y)) for i, x, y in zip(of, a, b) if i == k] for k in range(len(texts))]


def test_against_the_walk():
    random.seed(2)
    words = ["ein", "Wort,", "Satz.", "Ende!\n\n", "längeres", "日本語。", "x" * 40, "é", "z.B.", "„Ja.“"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(30, 400))) for _ in range(40)] + ["a" * 999, "é" * 700, " " * 500, "\n" * 400]
    most, overlap = [random.choice([60, 100, 251]) for _ in texts], [random.choice([0, 7, 30]) for _ in texts]
    for t, m, o, got in zip(texts, most, overlap, pieces(texts, most, overlap)):
        assert got == one_by_one(t, m, o)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\ńé。🎧️"), min_size=1, max_size=300), st.integers(1, 40), st.integers(0, 45))
def test_nothing_is_lost(text, most, overlap):
    got = pieces([text], [most], [overlap])[0]
    o = overlap if overlap < most else most // 2
    assert all(0 < b - a <= most for a, b in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(a == before - o for (_, before), (a, _) in zip(got, got[1:]))
    assert text[: got[0][1]] + "".join(text[a + o : b] for a, b in got[1:]) == text


def test_natural_places():
    text = "Erster Satz hier. " * 3 + "\n\n" + "Zweiter Absatz beginnt jetzt, und geht weiter. " * 3
    got = [text[a:b] for a, b in pieces([text], [60], [0])[0]]
    assert got[0] == "Erster Satz hier. " * 3 + "\n\n"
    assert all(g.rstrip().endswith((".", ",")) for g in got)
    clusters = pieces(["🎧️" * 50], [7], [0])[0]
    assert all(b % 2 == 0 for _, b in clusters)


def test_doubling_finds_the_whole_walk():
    step = np.array([1, 2, 3, 4, 5, 6, 7, 7])
    assert s.reached(step, np.array([0])).tolist() == list(range(8))
    assert s.reached(np.array([3, 1, 2, 5, 4, 5]), np.array([0])).tolist() == [0, 3, 5]


def test_rows(spark):
    limits = spark.createDataFrame([("teil", "*", 100, 10), ("chunk", "f5", 50, 5), ("chunk", "*", 80, 0), ("chunk", "*", 80, 0), (None, None, None, None)], "item_kind string, engine string, max_chars int, overlap_chars int")
    long = "Das ist ein Satz. " * 10
    rows = [("teil", 1, None, long), ("teil", 1, None, long), ("teil", 2, None, "kurz"), ("chunk", 1, "F5 ", long[:60]), ("chunk", 2, "neu", long[:60]), ("chunk", 3, None, long[:81]), ("chunk", 4, "f5", None), ("chunk", None, "f5", long), ("chunk", 5, "f5", ""), ("brief", 1, None, long), ("chunk", 6, "f5", "x" * 50)]
    items = spark.createDataFrame([(*r, 7) for r in rows], "item_kind string, item_id bigint, engine string, text string, max_chars int")
    got = s.split_oversized(items, limits).collect()
    assert {(r.item_kind, r.item_id) for r in got} == {("teil", 1), ("chunk", 1), ("chunk", 3)}
    teil = sorted((r.piece_no, r.start_pos, r.end_pos, r.piece) for r in got if r.item_kind == "teil")
    assert [p for p, *_ in teil] == list(range(len(teil))) and all(x == long[a:b] and len(x) <= 100 for _, a, b, x in teil)
    assert s.split_oversized(items.limit(0), limits).count() == 0 and s.split_oversized(items, limits.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a", "", " "])
def test_short(text):
    assert pieces([text], [5], [1])[0] == ([(0, len(text))] if text else [])

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lesewerk.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.parse_ranks(bpe.read_ranks()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks()), special_tokens={})


CASES = ["", " ", "Hello world", "Größe 12,5 €", "<|endoftext|> ist Text", "日本語のテキスト。", "🎧🎧️🎙", "a" * 5000, "\n\n  x\t\ty  ", "don't we'll I'd", "\u0000﻿", "ééé", "กขค", "x" * 300 + "é" * 300]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_library(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_stale_entries():
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6}
    assert bpe.merge(b"abcab", ranks) == [5, 3]
    assert bpe.merge(b"aaaa", ranks) == [6, 6]
    assert bpe.merge(b"bca", ranks) == [4, 0]


def test_small_cache_gives_the_same(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    small = bpe.Encoder(encoder.pieces.ranks)
    text = "eins zwei drei vier fünf eins zwei"
    assert small.encode(text) == encoder.encode(text) and len(small.pieces) <= 2


def test_rows(spark, encoder, monkeypatch):
    rows = [(1, "Hallo Welt", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x"), (4, "ja " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(df).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((i or 0, encoder.encode(t)) for i, t, _ in rows)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert n[2] == n[3] == 0 and n[1] == len(encoder.encode("Hallo Welt"))


def test_slices_of_long_texts(monkeypatch, encoder):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["abc", None, "x" * 40, "y"])], ["k", "t"])
    got = list(bpe._slices(batch, 1))
    assert [t for _, _, x in got for t in x] == ["abc", None, "x" * 40, "y"] and len(got) == 2


def test_vocabulary_is_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_VOCABULARY_BYTES", 10)
    (tmp_path / "big").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "big"))

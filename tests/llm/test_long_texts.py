"""No text, however long or odd, takes more than about linear time."""

import os
import time

import numpy as np
import pytest

from lesewerk.llm import bpe, lookalikes, sentences, spam, splitting

TEXTS = {
    "letters": "a" * 200_000, "hyphens": "a-" * 100_000, "initials": "A." * 100_000, "digits": "1" * 200_000, "price": "1" * 200_000 + "€", "dots": "." * 200_000, "spaces": " " * 200_000 + "x",
    "lines": "\n" * 200_000, "blank lines": "\n " * 100_000, "quotes": '!"' * 100_000, "tags": "<a x>" * 40_000, "brackets": "[" * 200_000, "emoji": "🎧️" * 100_000, "look-alikes": "о" * 200_000 + "д",
    "mixed": "aо" * 100_000, "Chinese": "中" * 200_000, "Thai": "ก " * 100_000, "addresses": "http://" * 30_000, "words": "wort " * 40_000, "names": "Aa. B. " * 30_000, "hosts": "a." * 100_000 + "com",
}


@pytest.mark.parametrize("kind", TEXTS)
def test_time(kind):
    text, model = TEXTS[kind], lookalikes.Model({})
    for work in (spam.measure, sentences.unit_ends, lambda t: splitting.cut([t], np.array([400]), np.array([40])), model.canonical):
        began = time.time()
        work(text)
        assert time.time() - began < 15


@pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")
@pytest.mark.parametrize("kind", TEXTS)
def test_encoding(kind):
    encoder = bpe.Encoder(bpe.parse_ranks(bpe.read_ranks()))
    began = time.time()
    ids = encoder.encode(TEXTS[kind])
    assert time.time() - began < 30
    assert encoder.decode(ids) == TEXTS[kind]

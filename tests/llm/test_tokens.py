"""Columns of texts get the ids that the library gives each text, and plain ones cheaply."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from hammerprice.llm import tokens

ODD = ["", None, " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \nb", "a\n b", "a\n\nb", "a\tb", "a\r\nb", "a\x00b", "a\x7fb", "a b", "a­b", "x² y", "¼ of", "ª º", "Straße, Été.", "don't, we'll. it's",
       "3,000. 4.", "word,. word., .word ,word , .", "snake_case, __", "a<|b", "<|endoftext|> b", "日本, 語.", "éte, é.", "ƒoo, ɏ. ɐ", "😀 b", "a b", "one\ntwo three\nfour, five.", "Ġa Ċ", "﻿a b", "a\u0085b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_get_the_ids_of_the_library(name):
    path = public_tokenizers.path(name)
    encoder, r = tokens.Encoder(path), np.random.default_rng(1)
    pieces = [*"abzÀéÿɏ.,'!|_09²<|", " ", " ", " ", "\n", "the", "Of", "'ll", " ", "日"]
    texts = ODD + ["".join(r.choice(pieces, r.integers(1, 12))) for _ in range(3_000)]
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    column = pa.array(["not of the slice", *texts]).slice(1)
    assert list(encoder.encode_all(column)) == want == [encoder.encode(t) for t in texts]


def test_plain_texts_cost_no_pattern_each(monkeypatch):
    """Neither are texts searched one by one, nor are words of letters cut into pieces."""
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["One of many words, été and others.", "two lines\nof them, here"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    cut, real = [], encoder.pieces
    encoder.pieces = lambda text: cut.append(text) or real(text)
    monkeypatch.setattr(tokens, "_LOOSE", None)
    assert list(encoder.encode_all(pa.array(texts))) == want
    assert not [x for x in cut if x.startswith(" ")]

"""Texts above every block size give what they would give whole."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from burnline.llm import bytebpe, minhash, toxicity, words
from burnline.llm.common import utf8

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["ab Cd éF " * 40 + "x" * 300 + " tail", "y" * 500, "", "one two three", " " * 200 + "z", "q" * 127 + " " + "Äb" * 90]


def test_toxicity(monkeypatch):
    gram = np.random.default_rng(0).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    offsets, raw = utf8(pa.array(TEXTS))
    whole = list(toxicity._texts(raw, offsets, gram))
    for block in (16, 64, 130):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for a, b in zip(whole, toxicity._texts(raw, offsets, gram), strict=True):
            assert np.allclose(a, b, atol=1e-5)


def test_upper_case_is_one_word():
    """Only A to Z is lower-cased, in training as in scoring."""
    gram = np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    one, two, other = (next(toxicity._texts(r, o, gram)) for o, r in (utf8(pa.array([t])) for t in ("STÉ ab", "stÉ AB", "sté ab")))
    assert np.allclose(one, two) and not np.allclose(one, other)


def test_word_hashes(monkeypatch):
    offsets, raw = utf8(pa.array(TEXTS))
    whole = list(minhash._documents(raw, offsets))
    for block in (16, 64, 130):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(words, "BLOCK", block)
        for a, b in zip(whole, minhash._documents(raw, offsets), strict=True):
            assert (a == b).all()


@pytest.mark.parametrize("long", [10, 1 << 16])
def test_byte_bpe(spark, monkeypatch, long):
    texts = [*TEXTS, "a b " * 40_000, "x" * 70_000, "\n\n a1" * 30_000, "漢字 kana 😀 " * 9_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = bytebpe.encoding(RANKS, public_tokenizers.PATTERN)
    rows = bytebpe.encode(df, RANKS, public_tokenizers.PATTERN, long).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids or b"", "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id] or "")

"""Phrase collocations against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from burnline.llm import phrases


def phrases_brute(docs, least=30, top=2000, drop=80):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    many = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    held = {}
    for (lang, w), a in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = lang, w[i : i + k]
                held[part] = max(held.get(part, 0), a)
    found = {}
    for (lang, w), a in many.items():
        if 100 * held.get((lang, w), 0) >= drop * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, rows in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "new", "york", "city", "é", "漢字", "\x00", " ", "x" * 40, *(f"w{i}" for i in range(30))]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", " ; ", "?!"]) for _ in range(rng.randrange(60)))
        if rng.random() < 0.4:
            text += " new york city hall " * rng.randrange(1, 4)
        out.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return out + [("en", None), (None, ""), ("fr", " \t "), ("fr", "...")] + [("de", "a b a b a b a b a b")] * 20


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "shard", "top"), [(5, 300, 2000), (12, 1 << 21, 7)])
def test_against_plain_counts(spark, least, shard, top):
    docs = texts(3)
    frame = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id bigint, text string, lang string, rank int, phrase string")
    got = rows_of(phrases.collocations(frame, least=least, top=top, shard=shard))
    assert got == phrases_brute(docs, least, top)
    assert got


def test_ties_go_by_bytes(spark):
    docs = [("en", f"{a} {b}.") for a, b in (("z", "é"), ("z", "~"), ("a", "b"), ("Ā", "x"), ("𐍈", "x"), ("￮", "x")) for _ in range(30)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert rows_of(phrases.collocations(frame)) == phrases_brute(docs)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "one two")], empty.schema)).count() == 0


def test_scores_past_64_bits(spark):
    frame = spark.createDataFrame([(9_000_000_000_000_000_000, 1, 2)], "f bigint, l bigint, r bigint")
    big = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_000, 9_000_000_000_000_001)], "f bigint, l bigint, r bigint")
    assert big.select(phrases.ratio("f", "l", "r")).first()[0] == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_001
    assert frame.select((phrases.decimal(100) * phrases.decimal("f")).alias("x")).first().x == 900_000_000_000_000_000_000


def test_bitmaps_shift_and_meet():
    rng = np.random.default_rng(5)
    at = rng.choice([0, 1, 2, 3, *range(4, 200)], size=5000, p=[0.1, 0.3, 0.2, 0.1, *[0.3 / 196] * 196]).astype(np.int32)
    maps = phrases.Bitmaps(at)
    assert {1, 2, 3} <= set(maps.dense) and len(maps.dense) < 150
    want = Counter((int(a), int(b)) for a, b in zip(at, at[1:]) if a and b)
    a, b, n = maps.pairs()
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want
    on = phrases.shifted(phrases.packed(maps.of(1), len(at)))
    assert np.flatnonzero(np.unpackbits(on.view(np.uint8), bitorder="little")).tolist() == (maps.of(1) + 1).tolist()


def test_long_texts_are_read_in_parts():
    text = (b"word and more, " * 9 + b"\n") * 9000
    parts = list(phrases._parts(text.translate(phrases.TABLE)))
    assert len(parts) > 1 and b"".join(parts) == text.translate(phrases.TABLE)
    assert all(p.endswith(b"\n") for p in parts[:-1])
    assert list(phrases._parts(b"x " * (1 << 20))) == [b"x " * (1 << 20)]

"""Rows that share an id but not a text or vector are documents and vectors of their own."""

import numpy as np
import pytest

from burnline.llm import embed_dedup, minhash

WORDS = [f"w{i}" for i in range(60)]
TEXT = " ".join(WORDS)


def found(spark, rows):
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect())


def test_documents(spark):
    other = " ".join(f"o{i}" for i in range(30))
    rows = [(3, TEXT), (5, other), (5, TEXT + " x"), (5, other), (7, None), (7, "a b"), (8, "a b"), (8, TEXT)]
    assert found(spark, rows) == sorted([(3, 56, 3, True), (5, 26, 5, True), (5, 57, 3, False), (5, 26, 5, True), (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (8, 56, 3, False)])


@pytest.mark.parametrize("share", [1, 3, 10_000])
def test_blocks_of_a_bucket(spark, monkeypatch, share):
    """Whatever the size of a block, links that stars miss are found: chains whose ends differ."""
    monkeypatch.setattr(minhash, "SHARE", share)
    rng, rows = np.random.default_rng(9), []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(90)]
        for _ in range(14):
            words = words.copy()
            words[int(rng.integers(0, 90))] = f"n{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(86)} for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min(root[j] for j in range(len(rows)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    assert [(d, c) for d, _, c, _ in found(spark, rows)] == list(enumerate(root))


def test_recall_at_the_threshold():
    """Pairs of similarity 0.75 meet in a band, and agree in enough bins, for sets of several sizes."""
    rng = np.random.default_rng(2)
    for shared in (6, 30, 150, 600, 2400):
        for _ in range(120):
            both, one, two = (rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) for n in (shared, shared // 6, shared // 6))
            a, b = (minhash.signature(np.unique(np.concatenate([both, x])))[: minhash.BANDS * minhash.ROWS] for x in (one, two))
            assert (a == b).reshape(minhash.BANDS, minhash.ROWS).all(axis=1).any()
            assert ((a & np.uint64(255)) == (b & np.uint64(255))).sum() >= minhash.AGREE


def test_vectors(spark):
    x, y = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, x, 0), (2, y, 0), (7, [0.0, 1.0, 0.02], 0), (2, x, 1), (2, x, 0)]
    out = embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (2, 1, 2, True), (7, 1, 2, False), (2, 0, 2, True)])

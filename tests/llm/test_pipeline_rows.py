"""Stages of the pipeline decide row by row, also where a doc_id repeats."""

import corpus_pipeline as cp

from test_llm import near_brute


def test_near_dedup_with_repeated_ids(spark):
    text = lambda g: " ".join(f"g{g}w{i}" for i in range(100))
    rows = [(3, text(0)), (5, text(0) + " x"), (5, text(1)), (7, text(1) + " y"), (9, text(2)), (9, text(3)), (11, text(3) + " z"), (2, text(4)), (None, text(4) + " n"), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect()), key=repr)
    alone = near_brute([(i, t) for i, (d, t) in enumerate(rows) if d is not None])
    whole = [r for r in rows if r[0] is not None]
    groups = {}
    for (_, _, c), r in zip(alone, whole, strict=True):
        groups.setdefault(c if r[1] else r, []).append(r)
    assert got == sorted([min(g, key=lambda r: r[0]) for g in groups.values()] + [r for r in rows if r[0] is None], key=repr)

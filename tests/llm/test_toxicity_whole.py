"""Every passage of a document counts, and documents of every length teach."""

import numpy as np

from burnline.llm import toxicity


def test_worst_passage_may_start_at_any_word():
    words = np.random.default_rng(0).normal(size=99)
    for n in (4, 5, 6, 7, 98, 99):
        assert np.isclose(toxicity.worst_passage(words[:n]), max(words[i : i + 4].mean() for i in range(n - 3)))
    insults = np.array([0, 3.0, 0, 0, 3.0, 0, 0, 0, 0])
    assert toxicity.worst_passage(insults) == toxicity.worst_passage(np.concatenate([[0.0], insults])) == 1.5


def test_long_documents_are_learnt_from(spark):
    """Toxic labels on long documents alone still teach."""
    filler = " ".join(f"calm{i % 40} water{i % 7}" for i in range(900))
    docs = [(i, filler[: 300 + i] if i % 2 else f"{filler} stupid idiot moron pathetic {filler[:500]}") for i in range(60)] + [(100, "you stupid idiot moron pathetic"), (101, "calm1 water2 calm3 water4 calm5")]
    assert all(len(t) > 1 << 13 for i, t in docs[:60] if i % 2 == 0)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, toxic int")
    for budget in (toxicity.BUDGET, 1000):
        model = toxicity.train(d, labels, budget=budget)
        assert model.scale
    score = {r.doc_id: r.toxicity for r in toxicity.scored(d, toxicity.train(d, labels)).collect()}
    assert score[100] > 0.5 > score[101]

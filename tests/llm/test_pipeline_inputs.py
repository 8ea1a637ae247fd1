"""Stages take columns of any name, null and empty texts, and empty tables."""

import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["fp", "share", "row", "top", "n", "keep_id", "group_size", "kept", "toxicity", "_row", "_rest", "component_id", "spans", "text_hash", "rep", "part", "length"]


@pytest.mark.parametrize("name, stage", cp.STAGES[:4])
def test_clashing_names(spark, name, stage):
    rows = [(1, "some quiet words of prose here", *NAMES), (1, "other words", *NAMES), (2, None, *NAMES), (3, "", *NAMES), (None, "no id at all", *NAMES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in NAMES))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) >= 4 and all(list(r)[2:] == NAMES for r in got)
    assert {r.text for r in got if r.doc_id == 1} == {"some quiet words of prose here", "other words"}


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_empty_table(spark, name, stage):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    assert stage(spark, docs, SF).count() == 0

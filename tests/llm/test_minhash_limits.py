"""Similarities that the bands aren't made for are refused."""

import pytest

from burnline.llm import minhash


def test_lower_similarities_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="75 or more"):
        minhash.near_duplicates(docs, 74)
    assert minhash.near_duplicates(docs, 80).count() == 1

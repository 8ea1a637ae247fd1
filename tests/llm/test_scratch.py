"""What a stage writes on its way is deleted, its result is not."""

import os

import corpus_pipeline as cp
from burnline.llm import common

SF = "/root/testdata/sf0.001"


def test_only_results_of_stages_stay(spark):
    root = common.shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    rows = cp.run(spark, SF)
    assert rows.count() > 0
    made = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before)
    assert made == ["pieces", "stage-exact_dedup", "stage-near_dedup", "stage-secrets", "stage-toxicity"]


def test_scratch_may_hold_scratch(spark):
    with common.scratch(spark):
        a = common.save(spark.range(3), "a", keep=True)
        with common.scratch(spark):
            common.save(spark.range(3), "b")
        c = common.save(spark.range(5), "c")
        assert c.count() == 5
    assert a.count() == 3

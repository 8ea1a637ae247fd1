"""The pipeline's stages, one after the other, against what each must keep."""

import corpus_pipeline as cp
from burnline.llm import secret_scan, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {}
    for name, stage in cp.STAGES:
        out = stage(spark, at, SF).persist()
        seen[name] = out
        if name != "packing":
            assert out.columns == docs.columns
            at = out
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in seen["toxicity"].collect()} == {r.doc_id for r in toxicity.scored(docs, model).where("toxicity < 0.5").collect()}
    texts = [r.text for r in seen["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) == seen["toxicity"].select("text").distinct().count()
    assert seen["secrets"].count() == seen["near_dedup"].count() <= len(texts)
    assert not [r.doc_id for r in seen["secrets"].collect() if secret_scan.base_spans(r.text or "")]
    total = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert total.where("n <> t").count() == 0 and total.count() == seen["secrets"].count()
    ran = cp.run(spark, SF)
    assert ran.count() == seen["packing"].count()

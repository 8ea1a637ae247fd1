"""The whole pipeline against a plain version of every stage."""

import numpy as np
import public_tokenizers
from test_llm import near_brute
from tokenizers import Tokenizer

import corpus_pipeline as cp
from burnline.llm import secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def test_run_is_what_plain_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    mild = {r.doc_id for r in toxicity.scored(docs, model).where("toxicity < 0.5").collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in mild}
    last = {}
    for d in sorted(rows):
        last[rows[d]] = d
    rows = {d: rows[d] for d in sorted(last.values())}
    rows = {d: rows[d] for d, _, c in near_brute(list(rows.items())) if c == d}
    field = secret_scan.learn(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"))
    rows = {d: secret_scan.redact(t, secret_scan.scan_texts([t], field)[0]) for d, t in rows.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in rows.items()}

    got = cp.run(spark, SF).collect()
    pieces = {(r.doc_id, r.start): bytes(r.ids) for r in got}
    assert len(pieces) == len(got)
    assert pieces == {(d, a): x[a : a + 4096].tobytes() for d, x in ids.items() for a in range(0, len(x), 4096)}
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in filled.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 4096

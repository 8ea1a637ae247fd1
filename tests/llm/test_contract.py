"""Every registered query on a small table of hard rows: names and types of the contract, and values against brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_filter_audit import audit_brute, result
from test_llm import near_brute
from test_phrases import phrases_brute, rows_of

from burnline.llm import queries, sharding, token_files

TYPES = {
    "op1_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_embedding_near_duplicates": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_exact_duplicates": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op11_streaming_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_phrases": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
}
BASE = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam"
DOCS = [
    (1, BASE), (2, BASE), (3, BASE + " erat"), (4, None), (5, ""), (6, "   "), (7, "one two"), (7, "one two"), (7, "other text under one id"),
    (8, 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and AKIA' + "A1B2" * 5 + " é secret: hunter22"), (9, "漢字 é 😀 <|endoftext|> " * 30),
    (10, "word " * 9000 + "Tail"), (11, "x" * 90_000), (12, "mixed CASE Text\twith\ntabs \x0b and \u00a0 spaces"), (13, "AKIA" + "Z" * 30 + " PassWord='abcdef' api-key:1234567 0123456789abcdef01234567"), (None, BASE), (14, "you stupid idiot"),
    (15, "BİZİ, KİŞİ."), (16, "İ. Kİ; aक़,"), (17, "one two three. " * 40),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hard"))
    more = lambda df: df.withColumn("row", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("kept", F.lit(True))
    more(spark.createDataFrame(DOCS, "doc_id bigint, text string")).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0, int(i == 14)) for i in (1, 2, 3, 7, 10, 12, 14)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 1)]
    more(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int")).write.parquet(f"{d}/embeddings.parquet")
    pages = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, None), (4, "v", ""), (5, "w\n", "é" * 70_000), (6, "x", "<p>a</p>")]
    more(spark.createDataFrame(pages, "page_id bigint, url string, html string")).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def ran(spark, folder):
    return {name: q(spark, folder).persist() for name, q in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORD_BPE)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("name", TYPES)
def test_names_and_types(ran, name):
    have = dict(ran[name].dtypes)
    assert {c: have.get(c) for c in TYPES[name]} == TYPES[name]


@pytest.mark.parametrize("name", [n for n in TYPES if n not in ("op3_embedding_near_duplicates", "op5_packing", "op6_warc", "op12_phrases", "op13_filter_audit")])
def test_one_row_a_document(ran, name):
    key = lambda x: -1 if x is None else x
    assert sorted((r.doc_id for r in ran[name].collect()), key=key) == sorted((d for d, _ in DOCS), key=key)


def test_token_files(ran, tokenizer):
    got = sorted(ran["op1_token_files"].collect(), key=lambda r: r.start)
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = ids_of(tokenizer, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards(ran):
    rows = ran["op2_shards"].collect()
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in DOCS)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for s in {r.shard for r in rows}:
        assert 0 <= s < 40 and sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({(r.shard, r["size"], r.text_crc32) for r in rows}) == len({(r["size"], r.text_crc32) for r in rows})


def test_balance_of_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).cast("int")).alias("text"))
    load = [r.n for r in sharding.shard(docs, 40).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(load) == 40 and max(load) - min(load) <= 1600


def test_near_duplicates(ran):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ran["op4_near_duplicates"].collect()]
    assert sorted(got, key=key) == sorted(near_brute(DOCS), key=key)


def test_packing(ran, tokenizer):
    rows = [r for r in ran["op5_packing"].collect()]
    pieces = sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for d, t in DOCS:
        ids = ids_of(tokenizer, t)
        want += [(-1 if d is None else d, len(ids), a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert pieces == sorted(want)
    for s in {r.sequence_id for r in rows}:
        held = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 4096


def test_warc(ran):
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    pages = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "é" * 70_000, 6: "<p>a</p>"}
    want = [(p, len((t or "").encode()), digest(t), *(("response", None) if p in (4, 5, 6) else ("revisit", 6 if t else 4))) for p, t in pages.items()]
    assert sorted(tuple(r)[:5] for r in ran["op6_warc"].select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_toxicity(ran):
    for r in ran["op7_toxicity"].collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_byte_bpe(ran):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(len(i := enc.encode_ordinary(t or "")), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for _, t in DOCS]
    assert sorted(tuple(r) for r in ran["op8_byte_bpe"].select("n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_exact_duplicates(ran):
    rows = ran["op9_exact_duplicates"].collect()
    groups = {}
    for d, t in DOCS:
        groups.setdefault(t or "", []).append(d)
    for t, ids in groups.items():
        same = [r for r in rows if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        top = max((d for d in ids if d is not None), default=None)
        assert len(same) == len(ids) and {(r.keep_id, r.group_size) for r in same} == {(top, len(ids))}
        assert [r.doc_id for r in same if r.kept] == [top]


def test_secrets(ran):
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    want = []
    for _, t in DOCS:
        spans = sorted(((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(patterns) for m in p.finditer(t or "") if ok(m)))
        count = [sum(k == x for _, _, x, _ in spans) for k in ("assign", "access", "hex")]
        want.append((*count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()))
    rows = ran["op10_secrets"].collect()
    assert sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == sorted(want)
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith("crf")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_streaming_bpe(ran, tokenizer):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for _, t in DOCS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(tuple(r) for r in ran["op11_streaming_bpe"].select("n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_phrases(ran):
    want = phrases_brute([("en", t) for _, t in DOCS])
    assert want and rows_of(ran["op12_phrases"]) == want


def test_filter_audit(ran):
    labels = [(i, 0, int(i == 14)) for i in (1, 2, 3, 7, 10, 12, 14)]
    assert result(ran["op13_filter_audit"].collect()) == audit_brute([(d, "s", t) for d, t in DOCS], labels)


def test_a_document_is_found_by_the_files_indexes(spark, tmp_path):
    """Row groups whose range or Bloom filter rules a doc_id out aren't read."""
    path = str(tmp_path / "tokens")
    docs = spark.range(0, 40_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(docs.coalesce(1), path, queries.WORD_BPE)
    rows = token_files.read_documents(spark, path, [30_000])
    assert [r.doc_id for r in rows.collect()] == [30_000]
    scan = rows._jdf.queryExecution().executedPlan()
    while not scan.children().isEmpty():
        scan = scan.children().head()
    assert 1 <= scan.metrics().apply("numOutputRows").value() <= 2_000 * 4
    missing = token_files.read_documents(spark, path, [30_001])
    assert missing.count() == 0

"""The filter audit against plain loops."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from burnline.llm import filter_audit


def audit_brute(docs, labels):
    """{(part, order, step): counts} of (doc_id, part, text) and (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    parts = {}
    for d, part, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > least[t],
        }
        parts.setdefault(part or "", []).append((d, fails))
    out = {}
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                gone = lambda fails, n: any(fails[x] for x in order[:n])  # noqa: B023, E731
                here = [d for d, fails in rows if fails[f] and not gone(fails, step)]
                removed_by[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(not gone(fails, step + 1) for _, fails in rows),
                    len(here),
                    sum(fails[f] and gone(fails, step) for _, fails in rows),
                    sum(fails[f] and sum(fails.values()) == 1 for _, fails in rows),
                    sum(d in good for d in here),
                    sum(d in toxic for d in here),
                ]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                out[part, "".join(order), step + 1].append(removed_by[f])
    return {k: tuple(v) for k, v in out.items()}


def result(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def hard_docs():
    rng = random.Random(4)
    words = ["a", "b", "Word", "ALL", "x#", "été", "漢字", "100%", " ", *(f"w{i}" for i in range(80))]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 49, 50, 51, 120]))) for _ in range(60)]
    texts += [None, "", "  \t\x0b ", "A" * 20 + " b" * 60, "\x1c\x1d " * 60, " ".join(f"u{i}" for i in range(100)), "a|b " + " ".join(f"v{i}" for i in range(70))]
    rows = [(i if i % 11 else None, [None, "s", "S", ""][i % 4], rng.choice(texts)) for i in range(300)]
    return rows + [(7, "s", texts[0]), (7, "s", texts[0]), (7, "t", texts[0]), (3, "s", "  other text of id 3")]


def test_against_plain_loops(spark):
    docs = hard_docs()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 250, 2)] + [(7, 0, 0), (7, 1, None), (None, 1, 1), (9, None, None), (5000, 1, 1)]
    frame = spark.createDataFrame([(d, t, p, "x", 1, True) for d, p, t in docs], "doc_id bigint, text string, source string, part string, step int, kept boolean")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = filter_audit.audit(frame, table).collect()
    assert len(got) == 600 * len({p or "" for _, p, _ in docs})
    assert result(got) == audit_brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = result(filter_audit.audit(one, labels).collect())
    assert got == audit_brute([(1, None, None)], [])


def scanned(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return [tuple(int(x) for x in row) for row in filter_audit.counts(np.frombuffer(b"".join(raw), np.uint8), offsets)]


def plainly(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)


def test_texts_of_many_blocks(monkeypatch):
    monkeypatch.setattr(filter_audit, "SCAN", 97)
    rng = random.Random(2)
    texts = ["", "a", "é" * 500, " " * 400, "x" * 300 + " " + "x" * 300 + "  y", *(" ".join(rng.choices(["aa", "B", "漢", "#", "z" * 150], k=rng.randrange(200))) for _ in range(40))]
    assert scanned(texts) == [plainly(t) for t in texts]


def test_a_text_above_the_block():
    text = " ".join(f"word{i % 70_001} É$" for i in range(400_000))
    assert len(text.encode()) > 2 * filter_audit.SCAN
    assert scanned(["a b a", text, "A b"]) == [plainly(t) for t in ("a b a", text, "A b")]


def test_words_of_one_hash_are_told_apart():
    raw = np.frombuffer(b"ab cd ab ef xy xy", np.uint8)
    s, e = np.array([0, 3, 6, 9, 12, 15]), np.array([2, 5, 8, 11, 14, 17])
    assert filter_audit.distinct_words(raw, s, e, np.zeros(6, np.uint64), np.array([0, 4, 6])).tolist() == [3, 1]

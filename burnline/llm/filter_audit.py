"""Operator 13: how five filters act on each other, in every order.

Texts are scanned where they lie in Arrow buffers: a table of byte classes and
prefix sums count words, capitals, symbols and code points of many documents at
once, and each document's distinct words are counted by sorting 64-bit hashes;
words of equal hashes are compared byte by byte. A document comes to a mask of
the filters that it fails. Copies are known by SHA-256, counted by (text, part,
labels) before anything is dealt out by text. A part comes to counts of its 32
masks, and fixed 0/1 matrices reduce these to its 600 rows.

Filters: A under `MIN_WORDS` words; B distinct words under `DISTINCT` percent;
C capitals above `CAPITALS` percent of code points; D any of `SYMBOLS`; E equal
to the text of a smaller doc_id. The capital and symbol classes are ASCII.

Nulls: a null text is empty, a null source the part ''. A row without a doc_id
neither fails E nor makes others fail it, and has no labels. Repeated rows are
documents of their own; rows of one doc_id and text don't fail E by each other.
A doc_id with several labels has quality or toxicity if any of them says 1. An
empty table has no parts. Other columns are ignored. A very long text is scanned
in blocks cut at white space; its words' hashes and places are held."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnline.llm.common import arrow_schema, pieces, utf8
from burnline.llm.words import INVERSE, SPACE, mix, powers, prefix, spans

#: The thresholds of filters A to C, and the symbols of D.
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
FILTERS = "ABCDE"
#: Bytes scanned at a time; counts of three classes share the prefix sums' 63 bits.
SCAN, FIELD = (1 << 21) - 1, 21
#: What a byte adds: a capital, a symbol, a code point (all but UTF-8's continuation bytes).
CLASS = np.zeros(256, np.int64)
CLASS[65:91] |= 1
CLASS[list(SYMBOLS)] |= 1 << FIELD
CLASS[[*range(0x80), *range(0xC0, 0x100)]] |= 1 << 2 * FIELD
SCHEMA = "doc_id bigint, part string, fails int, digest binary"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def classes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Capitals, symbols and code points of each text."""
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(CLASS[raw], out=total[1:])
    n, field = total[offsets[1:]] - total[offsets[:-1]], (1 << FIELD) - 1
    return n & field, n >> FIELD & field, n >> 2 * FIELD


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in `raw`."""
    s, e = spans(raw, offsets[:-1][offsets[:-1] < len(raw)])
    total = prefix(raw)
    return s, e, mix((total[e] - total[s]) * powers(INVERSE, len(raw) + 1)[s] + (e - s).astype(np.uint64))


def equal_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a equal those from b, for each of many triples; some bytes of all at a time."""
    same = np.ones(len(n), bool)
    ends = np.cumsum(n)
    for i, j in pieces(np.concatenate([[0], ends]), SCAN):
        if j - i == 1 and n[i] > SCAN:
            same[i] = bool((raw[a[i] : a[i] + n[i]] == raw[b[i] : b[i] + n[i]]).all())
            continue
        before = np.concatenate([[0], np.cumsum(n[i:j])])
        step = np.arange(before[-1])
        differ = raw[np.repeat(a[i:j] - before[:-1], n[i:j]) + step] != raw[np.repeat(b[i:j] - before[:-1], n[i:j]) + step]
        if differ.any():
            same[i + np.searchsorted(before, np.flatnonzero(differ), side="right") - 1] = False
    return same


def distinct_words(raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct words of each text; `first` is the number of words before each, and the total."""
    n = len(first) - 1
    bits = max(int(n - 1).bit_length(), 1)
    text = np.repeat(np.arange(n), np.diff(first))
    key = (text.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    order = np.argsort(key)
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[again], order[again + 1]
    same = (e - s)[a] == (e - s)[b]
    same[same] = equal_spans(raw, s[a[same]], s[b[same]], (e - s)[a[same]])
    out = np.diff(first) - np.bincount(text[a], minlength=n)
    for t in np.unique(text[a[~same]]):  # two words of one hash: these are counted by themselves
        out[t] = len({raw[x:y].tobytes() for x, y in zip(s[first[t] : first[t + 1]], e[first[t] : first[t + 1]], strict=True)})
    return out


def long_counts(raw: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, distinct words, capitals, symbols and code points of one long text, in blocks cut at white space."""
    found, totals, a = [], np.zeros(3, np.int64), 0
    while a < len(raw):
        b = min(a + SCAN, len(raw))
        for c in range(a, b, SCAN):
            totals += [int(x[0]) for x in classes(raw[c : min(c + SCAN, b)], np.array([0, min(c + SCAN, b) - c]))]
        end = b
        if b < len(raw):
            gaps = np.flatnonzero(SPACE[raw[a:b]])
            if len(gaps):
                end = a + int(gaps[-1]) + 1
            else:  # one word is longer than a block: it ends at the next space
                end = b
                while end < len(raw) and not SPACE[raw[end]]:
                    step = np.flatnonzero(SPACE[raw[end : end + SCAN]])
                    end = end + int(step[0]) if len(step) else min(end + SCAN, len(raw))
            for c in range(b, end, SCAN):
                totals += [int(x[0]) for x in classes(raw[c : min(c + SCAN, end)], np.array([0, min(c + SCAN, end) - c]))]
            if end < b:
                totals -= [int(x[0]) for x in classes(raw[end:b], np.array([0, b - end]))]
        s, e, h = word_hashes(raw[a:end], np.array([0, end - a]))
        found.append((s + a, e + a, h))
        a = end
    s, e, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return (len(s), int(distinct_words(raw, s, e, h, np.array([0, len(s)]))[0]), *map(int, totals))


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, symbols and code points (columns) of each text (rows)."""
    out = []
    for a, b in pieces(offsets, SCAN):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > SCAN:
            out.append(np.array([long_counts(part)]))
            continue
        s, e, h = word_hashes(part, at)
        first = np.searchsorted(s, at)
        out.append(np.stack([np.diff(first), distinct_words(part, s, e, h, first), *classes(part, at)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SCHEMA)
    for b in batches:
        offsets, raw = utf8(b.column(2))
        words, distinct, capitals, symbols, points = counts(raw, offsets).T
        fails = (words < MIN_WORDS) | (100 * distinct < DISTINCT * words) << 1 | (100 * capitals > CAPITALS * points) << 2 | (symbols > 0) << 3
        digest = [sha256(raw[x:y]).digest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fails.astype(np.int32)), pa.array(digest, pa.binary())], schema=schema)


def matrices() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each row, and for each count the masks that enter it (rows by 32)."""
    masks, rows, out = np.arange(32), [], {c: [] for c in ("kept", "removed", "redundant", "unique_fails")}
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            rows.append(("".join(order), step))
            out["kept"].append(masks & (before | bit) == 0)
            out["removed"].append((masks & bit > 0) & (masks & before == 0))
            out["redundant"].append((masks & bit > 0) & (masks & before > 0))
            out["unique_fails"].append(masks == bit)
            before |= bit
    return rows, {c: np.array(m, np.int64) for c, m in out.items()}


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, list of (mask, n, good, toxic)) to the rows of each part."""
    rows, m = matrices()
    letter = np.array([FILTERS.index(o[s - 1]) for o, s in rows])
    # Removed by a filter, summed over all orders: the same for each of its rows.
    shapley = np.stack([m["removed"][letter == f].sum(axis=0) for f in range(len(FILTERS))])[letter]
    order, step = pa.array([o for o, _ in rows]), pa.array([s for _, s in rows], pa.int32())
    for b in batches:
        flat, at = b.column(1).flatten(), b.column(1).offsets.to_numpy()
        fields = [f.to_numpy() for f in flat.flatten()]
        for p in range(b.num_rows):
            x = slice(at[p] - at[0], at[p + 1] - at[0])
            n, good, toxic = np.zeros((3, 32), np.int64)
            for total, values in zip((n, good, toxic), fields[1:], strict=True):
                np.add.at(total, fields[0][x], values[x])
            cols = [m["kept"] @ n, m["removed"] @ n, m["redundant"] @ n, m["unique_fails"] @ n, m["removed"] @ good, m["removed"] @ toxic, shapley @ n]
            part = pa.array([b.column(0)[p].as_py()] * len(rows), pa.string())
            yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(c, pa.int64()) for c in cols)], names=["part", "filter_order", "step", *COUNTS])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of filters A to D) and digest of the text, for each row."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text"))
    return rows.mapInArrow(_scanned, SCHEMA)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good and toxic: documents by what they fail."""
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").cast("string").alias("_of")).agg(said("quality"), said("toxic"))
    # Repeated rows become one before rows are dealt by doc_id, which may be anything's; those without one are dealt by their digests and find no label.
    rows = failures(docs).groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("_of", F.coalesce(F.col("doc_id").cast("string"), F.hex("digest"))).join(known, "_of", "left").na.fill(0, ["quality", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    copies = rows.groupBy("digest", "part", "fails", "quality", "toxic").agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a text has a row for each part and kind of label
    stays = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("_least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("fails").alias("mask"), stays.alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - stays).alias("n")))
    split = copies.withColumn("_least", least).select("part", "quality", "toxic", F.explode(both).alias("c"))
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("quality")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    return parts.mapInArrow(_reduced, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))

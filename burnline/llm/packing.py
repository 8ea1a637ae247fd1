"""Operator 5: packing token sequences, shortest pack first over the length histogram.

Documents are cut into pieces of at most `size` ids. Only the histogram of
piece lengths (at most `size` entries) reaches the driver. Lengths are placed
longest first: each goes to the packs that are shortest so far, as many at a
time as share a pattern, starting from about as many empty packs as the ids need
at least (of a few such numbers, the one that ends with the fewest packs); where
none has room, new packs open. Patterns meet the pieces again by
rank: a piece's rank among pieces of its length decides its sequence.

Nulls: a null text is empty and packs its end id alone; a null doc_id packs like
any other. Repeated rows are packed once each. An empty table gives no rows.
Other columns are ignored. A very long text becomes many pieces; its ids are held
by one task at a time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnline.llm.common import arrow_schema, save
from burnline.llm.wordbpe import runs

#: Bytes of ids that a task holds before it hands them on.
SENT = 4 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, part int, nth bigint, ids binary"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) that hold every piece of the histogram.

    Slot: the pieces of `length` ranked first rank .. + count go to the sequences
    first sequence .. + count, at `offset`. Work follows the number of patterns,
    not of pieces."""
    least = -(-sum(n * k for n, k in histogram.items()) // size)
    if not least:
        return []
    tried = (_place(histogram, size, least + least * extra // 1000) for extra in (0, 2, 5, 10, 15, 20, 30, 40, 60))
    return min(tried, key=lambda slots: max(s + n for _, _, n, s, _ in slots))


def _place(histogram: dict[int, int], size: int, empty: int) -> list[tuple[int, int, int, int, int]]:
    """The slots when `empty` packs are there from the start."""
    serial = 0
    # (ids so far, serial, count, pattern); a pattern is a chain (length, first rank of its slice, the pattern below).
    packs: list[tuple[int, int, int, tuple | None]] = [(0, 0, empty, None)]
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and packs[0][0] + length <= size:
                used, _, count, below = heapq.heappop(packs)
            else:
                used, count, below = 0, left, None
            take = min(count, left)
            serial += 1
            heapq.heappush(packs, (used + length, serial, take, (length, rank, 0, below)))
            if count > take:
                serial += 1
                heapq.heappush(packs, (used, serial, count - take, _advanced(below, take)))
            left -= take
            rank += take
    slots, sequence = [], 0
    for used, _, count, pattern in sorted(packs, key=lambda p: p[1]):
        at = used
        while pattern:
            length, rank, skip, pattern = pattern
            at -= length
            slots.append((length, rank + skip, count, sequence, at))
        sequence += count if used else 0
    return slots


def _advanced(pattern: tuple | None, by: int) -> tuple | None:
    """The same pattern for the packs after the first `by`."""
    chain = []
    while pattern:
        chain.append(pattern[:3])
        pattern = pattern[3]
    for length, rank, skip in reversed(chain):
        pattern = (length, rank, skip + by, pattern)
    return pattern


def _cut(tokenizer: str, end_id: int, size: int):
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = runs(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        rows, cuts, held = [], [], 0

        def batch_of() -> pa.RecordBatch:
            numbers = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(numbers, schema, strict=False)), pa.array(cuts, pa.binary())], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                for a in range(0, len(raw), 4 * size):
                    cut = raw[a : a + 4 * size]
                    n = len(cut) // 4
                    rows.append((doc.as_py(), a // 4, n, len(raw) // 4, part, int(seen[n])))
                    cuts.append(cut)
                    seen[n] += 1
                held += len(raw)
                if held >= SENT:
                    yield batch_of()
                    rows, cuts, held = [], [], 0
        if rows:
            yield batch_of()

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit) and place: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    spark = docs.sparkSession
    cut = save(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_cut(tokenizer, end_id, size), SCHEMA), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = sorted(shortest_pack_first(histogram, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    table = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5))  # bounded by patterns of a histogram of `size` lengths

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = table.value
        at = np.searchsorted(t[:, 0] * (1 << 44) + t[:, 1], length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy() - t[at, 1], "offset": t[at, 4]})

    ranked = cut.join(base, ["part", "length"]).withColumn("_to", place("length", F.col("base") + F.col("nth")))
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "_to.sequence_id", "_to.offset")

"""Operator 2: shards of near-equal bytes by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Sorted by size, each enters the bin with
the tightest remaining capacity that holds it, found in a balanced tree; the
capacity is the least for which the bins suffice. A group that outweighs an
even share has a shard of its own, and the rest are packed into the others.

The driver sees a histogram of group sizes, not the groups: sizes are exact up
to EXACT bytes, grouped to 1 part in 1024 above (the largest size of a class
stands for it), so the histogram is bounded whatever the input; classes with few
members go one by one, and runs of one class enter a bin together. Ranks within
a class then give each group its shard, in parallel.

Nulls: a null text has no bytes and shares the group of empty texts; null doc_ids
count like others. Repeated rows stay together. An empty table gives no rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.common import dense_rank_in, save

EXACT, STEPS = 1 << 16, 1024


class Tree:
    """A treap of (remaining, bin): a balanced search tree in expectation."""

    def __init__(self):
        self.root, self.rng = None, random.Random(1)

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Tree._merge(a[3], b)
            return a
        b[2] = Tree._merge(a, b[2])
        return b

    @staticmethod
    def _split(t, key):
        """Keys below `key`, and the rest."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = Tree._split(t[3], key)
            return t, right
        left, t[2] = Tree._split(t[2], key)
        return left, t

    def add(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.rng.random(), None, None]), right)

    def take(self, least: int):
        """Remove and return the smallest (remaining, bin) with remaining >= least, or None."""
        left, right = self._split(self.root, (least, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, right = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, right)
        return node[0]


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, count, bin) for classes (size, count) in falling order, or None if they don't fit."""
    tree, runs = Tree(), []
    for b in range(bins):
        tree.add((capacity, b))
    for size, count in classes:
        rank = 0
        while count:
            bin_ = tree.take(size)
            if bin_ is None:
                return None
            take = min(count, bin_[0] // size) if size else count
            runs.append((size, rank, take, bin_[1]))
            tree.add((bin_[0] - take * size, bin_[1]))
            rank, count = rank + take, count - take
    return runs


def pack_classes(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs for all classes: own shards for groups above an even share, best fit at the least capacity for the rest."""
    classes = sorted(((s, n) for s, n in classes if n), reverse=True)
    runs, used = [], 0
    total = sum(s * n for s, n in classes)
    rank = 0
    while classes and used < shards - 1 and classes[0][0] * (shards - used) > total:
        size, n = classes[0]
        runs.append((size, rank, 1, used))
        used, total, rank = used + 1, total - size, rank + 1
        classes[0] = (size, n - 1)
        if n == 1:
            classes.pop(0)
            rank = 0
    if classes:
        start, left = {classes[0][0]: rank}, shards - used
        low, high = max(classes[0][0], -(-total // left)) - 1, total
        found = best_fit(classes, high, left)
        while high - low > max(1, low // (1 << 20)):
            mid = (low + high) // 2
            if (packed := best_fit(classes, mid, left)) is None:
                low = mid
            else:
                high, found = mid, packed
        runs += [(s, r + start.get(s, 0), c, b + used) for s, r, c, b in found]
    return runs


def size_class(size):
    """The class of a size: itself up to EXACT; above, rounded up to 1 part in 1024 or less."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 10).cast("bigint")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step).cast("bigint") * step)


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group (the digest of equal texts) of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", raw.alias("_raw")).select("doc_id", (F.octet_length("_raw") + overhead).cast("bigint").alias("size"), F.crc32("_raw").alias("text_crc32"), F.unhex(F.sha2("_raw", 256)).alias("group"))
    rows = save(rows, "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("total")).withColumn("class", size_class(F.col("total")))
    ranked = save(dense_rank_in(groups.select("group", "class"), ["class"], ["group"], "rank"), "ranks")
    classes = [(r["class"], r.n) for r in ranked.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]  # bounded: see size_class
    runs = pack_classes(classes, shards)
    spark = docs.sparkSession
    table = spark.createDataFrame([(s, r, r + c, b) for s, r, c, b in runs], "class bigint, low bigint, high bigint, shard int")
    # A class has as many runs as the bins it was dealt to.
    within = table.groupBy("class").agg(F.collect_list(F.struct("low", "high", "shard")).alias("runs"))
    placed = ranked.join(within, "class").select("group", F.expr("filter(runs, r -> r.low <= rank and rank < r.high)[0].shard").alias("shard"))
    out = save(rows.join(placed, "group"), "placed")
    out = dense_rank_in(out, ["shard"], ["doc_id", "group"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group")

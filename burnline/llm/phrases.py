"""Operator 12: phrase collocations from position bitmaps.

Texts become shards: the words of many documents in a row, a gap after each piece
(phrases don't cross punctuation or line ends), so that each word has a bitmap of
its positions. Bitmaps are compressed: sorted positions where a word is rare, 64-bit
words where it is dense. A bitmap shifted by one place and combined by AND with
that of another word is the bitmap of both in a row, and its popcount their number.

A shard can't know by itself which phrases are frequent, so it descends twice.
First one step, from words that are frequent over all shards, to all pairs; then
depth-first, from each pair that is frequent over all shards, over pairs that are
so too, to phrases of three and four words. Popcounts are summed over shards by
phrase: a shard deals its phrases to buckets by their hash, a bucket is one task's
and its number grows with the positions. A word's id is the smallest number that a
shard gave it, and a phrase's those of its words, so there is no dictionary that one
task or the driver would hold; lists of what is frequent go back to a shard as its
own rows, no more than the shard has positions.

Nulls: a null text is empty, a null lang `und`, a doc_id isn't looked at. Repeated
rows count each. An empty table gives no rows. Other columns are ignored. A piece is
never cut, so a shard is as long as its longest piece at least."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnline.llm.common import arrow_schema, save
from burnline.llm.words import mix

#: Positions after which a shard is closed; share of positions above which a word's bitmap is packed; positions descended from, and bytes of text read, at a time.
SHARD, DENSE, ROOTS, READ = 1 << 21, 64, 1 << 18, 1 << 20
#: Bits of a number within a shard (a text of 2 GB has no more words), and of a shard's within its task.
WITHIN, SERIAL = 30, 12
LEAST, DROP, SCALE, TOP = 30, 80, 2_000_000, 2000
#: A-Z become lower case, a tab a space, and what ends a piece a line feed.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class Codes(dict):
    """Word -> its number in the shard, given when it is first met; the gap is 0 and the empty string -1."""

    def __init__(self, shard: Words, lang: str):
        super().__init__({b"\n": 0, b"": -1})
        self.shard, self.lang = shard, lang

    def __missing__(self, word: bytes) -> int:
        self.shard.words.append((self.lang, word))
        code = self[word] = len(self.shard.words)
        return code


class Words:
    """A shard that grows: numbers of words in order of position, and the words."""

    def __init__(self) -> None:
        self.words: list[tuple[str, bytes]] = []
        self.codes: dict[str, Codes] = {}
        self.at: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        """Whole pieces of a text, by TABLE."""
        known = self.codes.get(lang)
        if known is None:
            known = self.codes[lang] = Codes(self, lang)
        found = text.replace(b"\n", b" \n ").split(b" ")
        at = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
        at = np.append(at[at >= 0], np.int32(0))
        at = at[(at > 0) | np.concatenate([[False], at[:-1] > 0])]  # one gap between pieces
        self.at.append(at)
        self.size += len(at)

    def row(self, number: int) -> pa.RecordBatch:
        at = np.concatenate(self.at)
        counts = np.bincount(at, minlength=len(self.words) + 1)[1:].astype(np.int32)
        lists = [pa.array([w], kind) for w, kind in (([w[0] for w in self.words], pa.list_(pa.string())), ([w[1].decode() for w in self.words], pa.list_(pa.string())), (counts, pa.list_(pa.int32())))]
        squeezed = pa.compress(at.tobytes(), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([squeezed], pa.binary()), *lists], names=["shard", "size", "codes", "langs", "words", "counts"])


def _parts(text: bytes) -> Iterator[bytes]:
    """A text some whole pieces at a time."""
    a = 0
    while len(text) - a > READ:
        b = text.find(b"\n", a + READ) + 1 or len(text)
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, done, shard = TaskContext.get().partitionId() << SERIAL, 0, Words()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for part in _parts(text.as_buffer().to_pybytes().translate(TABLE)):
                    shard.add(lang, part)
                    if shard.size >= limit:
                        yield shard.row(number + done)
                        done, shard = done + 1, Words()
                        if done >> SERIAL:
                            raise OverflowError("an input partition is too large: read it in smaller ones (spark.sql.files.maxPartitionBytes)")
        if shard.size:
            yield shard.row(number + done)

    return run


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, its size, its numbers of words by position (int32, zstd), and for each number from 1 lang, word and count."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_shards(size), "shard bigint, size int, codes binary, langs array<string>, words array<string>, counts array<int>")


def packed(positions: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of positions in 64-bit words."""
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def shifted(bits: np.ndarray) -> np.ndarray:
    """The bitmap one place on."""
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


class Bitmaps:
    """The positions of each of a shard's symbols: `at` has the symbol of each position, 0 for none."""

    def __init__(self, at: np.ndarray):
        self.at = np.append(at, 0).astype(np.int64)
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.order, self.size = order, len(at)
        self.dense = [int(x) for x in np.flatnonzero(counts * DENSE > len(at)) if x]
        self.bits = {x: packed(self.of(x), self.size) for x in self.dense}

    def of(self, symbol: int) -> np.ndarray:
        return self.order[self.start[symbol] : self.start[symbol + 1]]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Symbols some at a time, as roots to descend from: (the root, the position) of each bit of theirs."""
        a, last = 1, len(self.start) - 1
        while a < last:
            b = min(max(a + 1, int(np.searchsorted(self.start, self.start[a] + ROOTS, side="right")) - 1), last)
            yield np.repeat(np.arange(a, b), np.diff(self.start[a : b + 1])), self.order[self.start[a] : self.start[b]]
            a = b

    def step(self, phrase: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shift each phrase's bitmap and AND it with all symbols': (phrase, symbol, popcount) of what isn't empty, and the bitmaps.

        The symbol that stands where a shifted bit falls is the one symbol whose bitmap has that bit. The last result
        is the new positions, those of each new phrase in a row."""
        symbol = self.at[position + 1]
        hit = symbol > 0
        phrase, symbol, position = phrase[hit], symbol[hit], position[hit] + 1
        both = phrase * len(self.start) + symbol  # under 2^63: neither passes the positions of a shard
        order = np.argsort(both)
        both, position = both[order], position[order]
        heads = np.flatnonzero(np.diff(both, prepend=-1))
        return both[heads] // len(self.start), both[heads] % len(self.start), np.diff(heads, append=len(both)), position

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, symbol, popcount) of all symbols that stand in a row."""
        found = []
        heavy = np.zeros(len(self.start), bool)
        heavy[self.dense] = True
        for x in self.dense:  # packed bitmaps meet as such
            on = shifted(self.bits[x])
            n = np.array([int(np.bitwise_count(on & self.bits[y]).sum()) for y in self.dense])
            found.append((np.full(len(n), x)[n > 0], np.array(self.dense)[n > 0], n[n > 0]))
        for phrase, position in self.blocks():
            rest = ~(heavy[phrase] & heavy[self.at[position + 1]])
            found.append(self.step(phrase[rest], position[rest])[:3])
        return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of rows in ascending order of the first, in a few bytes a row: differences, byte by byte, zstd."""
    flat = np.stack([np.diff(columns[0], prepend=0), *columns[1:]]).astype("<i8")
    return pa.compress(flat.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def spread(blob: bytes, columns: int, rows: int) -> np.ndarray:
    """The columns of `squeeze`."""
    raw = np.frombuffer(pa.decompress(blob, 8 * columns * rows, codec="zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(columns, 8, rows).transpose(0, 2, 1)).view("<i8").reshape(columns, rows).copy()
    flat[0] = np.cumsum(flat[0])
    return flat


def dealt(columns: list[np.ndarray], keys: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """(bucket, rows, blob) of rows dealt by a hash of their first `keys` columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns[:keys]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((*columns[keys - 1 :: -1], bucket))
    bucket, rows = bucket[order], [c[order] for c in columns]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[x]), int(y - x), squeeze([c[x:y] for c in rows])) for x, y in zip(heads, np.append(heads[1:], len(bucket)), strict=False)]  # heads may be none


def _shard(shard: pa.Table, lists: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The symbol at each position (0: a gap, or a word that isn't frequent), and the ids of words by symbol; symbols ascend with ids."""
    size = shard.column("size")[0].as_py()
    at = np.frombuffer(pa.decompress(shard.column("codes")[0].as_py(), 4 * size, codec="zstd", asbytes=True), np.int32)
    of_words = lists.filter(pc.is_valid(lists.column("gid")))
    k, gid = (of_words.column(c).to_numpy() for c in ("k", "gid"))
    order = np.argsort(gid)
    symbol = np.zeros(int(max(at.max(initial=0), k.max(initial=0))) + 1, np.int32)
    symbol[k[order]] = np.arange(1, len(k) + 1)
    return symbol[at], np.append(-1, gid[order])


PAIRS = "bucket bigint, shard bigint, rows bigint, blob binary"


def _pairs(buckets: int):
    shape = arrow_schema(PAIRS)

    def run(key: tuple, shard: pa.Table, lists: pa.Table) -> pa.Table:
        """A shard and its frequent words (k, gid) to its pairs of these (a, b, popcount), dealt by pair."""
        if not shard.num_rows or not lists.num_rows:
            return shape.empty_table()
        at, gid = _shard(shard, lists)
        a, b, n = Bitmaps(at).pairs()
        parts = dealt([gid[a], gid[b], n], 2, buckets)
        cols = [[p[0] for p in parts], [key[0].as_py()] * len(parts), [p[1] for p in parts], [p[2] for p in parts]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, shape, strict=True)], schema=shape)

    return run


FOUND = "shard bigint, a bigint, b bigint, f bigint, rows bigint, blob binary"


def _summed(rows: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by their keys: the order, where each phrase begins, and each phrase's sum of the column after the keys."""
    order = np.lexsort(rows[keys - 1 :: -1])
    by = rows[:, order]
    heads = np.flatnonzero(np.concatenate([[True], (by[:keys, 1:] != by[:keys, :-1]).any(axis=0)])) if rows.shape[1] else order
    return order, heads, np.add.reduceat(by[keys], heads) if len(heads) else heads


def _frequent_pairs(least: int):
    shape = arrow_schema(FOUND)

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        """A bucket of pairs to those that are frequent (a, b, f), and for each shard those of them that it has (blob of a, b)."""
        counts, blobs, shards = (parts.column(c).to_pylist() for c in ("rows", "blob", "shard"))
        rows = np.concatenate([spread(b, 3, n) for b, n in zip(blobs, counts, strict=True)], axis=1)
        order, heads, f = _summed(rows, 2)
        many = f >= least
        a, b = rows[0][order[heads[many]]], rows[1][order[heads[many]]]
        kept = np.zeros(rows.shape[1], bool)
        kept[order] = np.repeat(many, np.diff(heads, append=len(order)))
        lists, at = [], 0
        for shard, n in zip(shards, counts, strict=True):
            here = np.flatnonzero(kept[at : at + n]) + at
            at += n
            if len(here):
                lists.append((shard, len(here), squeeze([rows[0][here], rows[1][here]])))
        none, gone = [None] * len(a), [None] * len(lists)
        cols = [[*none, *(x[0] for x in lists)], [*a.tolist(), *gone], [*b.tolist(), *gone], [*f[many].tolist(), *gone], [*none, *(x[1] for x in lists)], [*none, *(x[2] for x in lists)]]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, shape, strict=True)], schema=shape)

    return run


LONGER = "bucket bigint, rows bigint, blob binary"


def _longer(buckets: int):
    shape = arrow_schema(LONGER)

    def run(key: tuple, shard: pa.Table, lists: pa.Table) -> pa.Table:
        """A shard, its frequent words and its frequent pairs to its phrases of three (d is -1) and four words (a, b, c, d, popcount), dealt by phrase."""
        of_pairs = lists.filter(pc.is_valid(lists.column("blob")))
        if not shard.num_rows or not of_pairs.num_rows:
            return shape.empty_table()
        at, gid = _shard(shard, lists)
        listed = np.concatenate([spread(b, 2, n) for b, n in zip(of_pairs.column("blob").to_pylist(), of_pairs.column("rows").to_pylist(), strict=True)], axis=1)
        first, second = np.searchsorted(gid, listed)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        pair, two = first * len(gid) + second, at[:-1].astype(np.int64) * len(gid) + at[1:]
        place = np.minimum(np.searchsorted(pair, two), len(pair) - 1)
        # The pair that ends at each position: two pairs stand in a row where three words do.
        maps, out = Bitmaps(np.append(np.int32(0), np.where(pair[place] == two, place + 1, 0).astype(np.int32))), []
        first, second = np.append(0, first), np.append(0, second)
        for phrase, position in maps.blocks():
            p, q, n, on = maps.step(phrase, position)
            out.append((first[p], second[p], second[q], np.zeros(len(n), np.int64), n))
            # Deeper: the phrases of three words are this block's roots.
            triple, r, m, _ = maps.step(np.repeat(np.arange(len(n)), n), on)
            out.append((first[p[triple]], second[p[triple]], second[q[triple]], second[r], m))
        a, b, c, d, n = (np.concatenate(x) for x in zip(*out, strict=True))
        parts = dealt([gid[a], gid[b], gid[c], gid[d], n], 4, buckets)
        cols = [[p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, shape, strict=True)], schema=shape)

    return run


def _frequent_longer(least: int):
    def run(parts: pa.Table) -> pa.Table:
        rows = np.concatenate([spread(b, 5, n) for b, n in zip(parts.column("blob").to_pylist(), parts.column("rows").to_pylist(), strict=True)], axis=1)
        order, heads, f = _summed(rows, 4)
        many = f >= least
        return pa.table([*(rows[c][order[heads[many]]] for c in range(4)), f[many]], names=["a", "b", "c", "d", "f"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Phrases of at least `least` occurrences: words (gid, lang, word, f), pairs (a, b, f), threes (a, b, c, f), fours (a, b, c, d, f); and lang, n.

    a to d are the ids of words."""
    cut = save(shards(docs, shard), "shards")
    listed = cut.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("k", "w"))
    listed = listed.select(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), (F.shiftleft("shard", WITHIN) + F.col("k") + 1).alias("id"), F.col("w.counts").cast("bigint").alias("n"))
    total = listed.groupBy("lang").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang", "word")
    words = save(listed.withColumn("f", F.sum("n").over(w)).where(F.col("f") >= least).withColumn("gid", F.min("id").over(w)).drop("n"), "words")
    # A bucket is a share of all phrases that one task sums: about a million positions' worth, however many there are.
    positions = cut.agg(F.sum("size").alias("n")).first().n or 0
    buckets = 1 + (positions >> 20)
    of_words = words.select(F.shiftright("id", WITHIN).alias("shard"), F.col("id").bitwiseAND((1 << WITHIN) - 1).alias("k"), "gid", F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("binary").alias("blob"))
    body = cut.select("shard", "size", "codes").groupBy("shard")
    dealt_pairs = body.cogroup(of_words.groupBy("shard")).applyInArrow(_pairs(buckets), PAIRS)
    pairs = save(dealt_pairs.groupBy("bucket").applyInArrow(_frequent_pairs(least), FOUND), "pairs")
    of_pairs = pairs.where("shard IS NOT NULL").select("shard", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("gid"), "rows", "blob")
    dealt_longer = body.cogroup(of_words.unionByName(of_pairs).groupBy("shard")).applyInArrow(_longer(buckets), LONGER)
    longer = save(dealt_longer.groupBy("bucket").applyInArrow(_frequent_longer(least), "a bigint, b bigint, c bigint, d bigint, f bigint"), "longer")
    return words.where("id = gid").select("gid", "lang", "word", "f"), pairs.where("shard IS NULL").select("a", "b", "f"), longer.where("d < 0").drop("d"), longer.where("d >= 0"), total


def decimal(x: int | str) -> Column:
    """An exact number whose products pass 64 bits."""
    return (F.lit(x) if isinstance(x, int) else F.col(x)).cast("decimal(19,0)")


def ratio(f: str, left: str, right: str) -> Column:
    """floor(SCALE * f / (left + right)), exactly."""
    return F.expr(f"CAST({SCALE} AS decimal(19,0)) * CAST({f} AS decimal(19,0)) div (CAST({left} AS decimal(19,0)) + CAST({right} AS decimal(19,0)))")


def ranked(rows: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """`rows` with `rank`, from 1 in each key, by `order`: rows are dealt by ranges, counted by range and key, and numbered within."""
    dealt_out = rows.repartitionByRange(F.col(key), *order).select(*columns, F.spark_partition_id().alias("_part"))
    dealt_out = save(dealt_out, "ranges")
    sizes = dealt_out.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range and key in it
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return dealt_out.withColumn("_at", within).join(sizes, [key, "_part"]).withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_before", "_part")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """Each lang's `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, pairs, threes, fours, total = frequent_phrases(docs, least, shard)
    word = lambda side, *names: words.select(F.col("gid").alias(side), *(F.col(c).alias(n) for c, n in names))
    p2 = save(pairs.join(word("a", ("lang", "lang"), ("word", "wa"), ("f", "fa")), "a").join(word("b", ("word", "wb"), ("f", "fb")), "b"), "pairs-said")
    # The two pairs that a phrase of three begins and ends with, and so on.
    named = lambda rows, old, new: rows.select(*(F.col(o).alias(n) for o, n in zip(old, new, strict=True)))
    head = named(p2, ["a", "b", "lang", "wa", "wb", "fa", "f"], ["a", "b", "lang", "wa", "wb", "fa", "f_head"])
    tail = lambda *at: named(p2, ["a", "b", "wa", "wb", "fb", "f"], [*at, "wy", "wz", "fz", "f_tail"])
    p3 = threes.join(head, ["a", "b"]).join(tail("b", "c"), ["b", "c"])
    p4 = fours.join(named(threes, ["a", "b", "c", "f"], ["a", "b", "c", "f_first"]), ["a", "b", "c"]).join(named(threes, ["a", "b", "c", "f"], ["b", "c", "d", "f_rest"]), ["b", "c", "d"])
    p4 = p4.join(head, ["a", "b"]).join(tail("c", "d"), ["c", "d"])
    cut = lambda k, left, right: F.struct(ratio("f", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    said = lambda *names: F.concat_ws(" ", *names).alias("phrase")
    none = F.lit(-1).cast("bigint")
    all_of = (
        p2.select("a", "b", none.alias("c"), none.alias("d"), "lang", said("wa", "wb"), "f", cut(1, "fa", "fb").alias("cut"))
        .unionByName(p3.select("a", "b", "c", none.alias("d"), "lang", said("wa", "wb", "wz"), "f", F.least(cut(1, "fa", "f_tail"), cut(2, "f_head", "fz")).alias("cut")))
        .unionByName(p4.select("a", "b", "c", "d", "lang", said("wa", "wb", "wy", "wz"), "f", F.least(cut(1, "fa", "f_rest"), cut(2, "f_head", "f_tail"), cut(3, "f_first", "fz")).alias("cut")))
    )
    # What longer phrases hold: pairs and phrases of three words, by the most frequent phrase around each.
    parts = [(threes, "a", "b", None), (threes, "b", "c", None), *((fours, *x) for x in (("a", "b", None), ("b", "c", None), ("c", "d", None), ("a", "b", "c"), ("b", "c", "d")))]
    held = [rows.select(F.col(x).alias("a"), F.col(y).alias("b"), (F.col(z) if z else none).alias("c"), none.alias("d"), "f") for rows, x, y, z in parts]
    held = reduce(DataFrame.unionByName, held).groupBy("a", "b", "c", "d").agg(F.max("f").alias("most"))
    kept = all_of.join(held, ["a", "b", "c", "d"], "left").where(F.col("most").isNull() | (decimal(100) * decimal("most") < decimal(DROP) * decimal("f")))
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = ranked(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], kept.columns).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

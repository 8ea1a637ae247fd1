"""Operator 9: exact duplicates by composable polynomial fingerprints.

A text's bytes x_0 .. x_(n-1) have the fingerprint sum x_i * b**(n-1-i) modulo
the prime 2**31 - 1, for two bases. Fingerprints compose: that of a text is that
of its head times b**(bytes of the tail) plus that of the tail. So texts above
`HUGE` bytes are cut into chunks that any tasks hash, and a grouped sum of
length-shifted chunk hashes gives theirs. Texts that share a fingerprint with
another are then compared, chunk by chunk, with one representative; those that
differ from it (a collision) are told apart by their SHA-256.

Nulls: a null text is empty and equals empty ones; a null doc_id never stays
while a copy has an id. Ties: rows with the same doc_id and text form one group,
of which one row stays. An empty table gives no rows. Other columns pass through
unless they carry a name this operator uses (ADDED; those are replaced or dropped).

A group's rows are dealt to SALTS shares: a share is what is grouped and joined,
so no group, however many copies it has, lands in one task. Texts move once, to
their shares, and are written there with what is known of their group; of these
only copies move again, to be compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnline.llm.common import salt, save, utf8

PRIME = 2**31 - 1
BASES = (1_000_003, 998_244_353)
#: Bytes hashed by one dot product, and bytes of a text above which other tasks help.
CHUNK, HUGE = 1 << 16, 32 << 20
#: Shares of a group of copies.
SALTS = 16
ADDED = ("fp", "share", "row", "top", "n", "keep_id", "group_size", "kept")


def _powers(base: int) -> np.ndarray:
    out = np.empty(CHUNK + 1, np.uint64)
    out[0] = 1
    done = 1
    while done <= CHUNK:
        take = min(done, CHUNK + 1 - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += take
    return out


POWERS = tuple(_powers(b) for b in BASES)


def chunk_hash(raw: np.ndarray) -> tuple[int, ...]:
    """Fingerprint of at most CHUNK bytes: products stay under 2**40, their sums under 2**56."""
    x = raw.astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(x, p[len(raw) - 1 :: -1][: len(raw)]) % PRIME) if len(raw) else 0 for p in POWERS)


def combine(head: tuple[int, ...], tail: tuple[int, ...], tail_bytes: int) -> tuple[int, ...]:
    """Fingerprint of head + tail."""
    return tuple((h * pow(b, tail_bytes, PRIME) + t) % PRIME for h, t, b in zip(head, tail, BASES, strict=True))


def fingerprint(raw: np.ndarray) -> tuple[int, ...]:
    out = chunk_hash(raw[:CHUNK])
    for a in range(CHUNK, len(raw), CHUNK):
        part = raw[a : a + CHUNK]
        out = combine(out, chunk_hash(part), len(part))
    return out


def _name(hashes: tuple[int, ...], size: int) -> str:
    return f"{size:x}.{hashes[0]:08x}{hashes[1]:08x}"


def _batch(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    return [_name(fingerprint(raw[a:b]), int(b - a)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add fp to rows whose last column is the text."""
    for batch in batches:
        offsets, raw = utf8(batch.column(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_batch(raw, offsets), pa.string())], names=[*batch.schema.names, "fp"])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, after, chunk) to (row, size, h0, h1): chunk hashes shifted by the bytes after them."""
    for batch in batches:
        offsets, raw = utf8(batch.column(2))
        out = []
        for a, b, after in zip(offsets[:-1], offsets[1:], batch.column(1).to_pylist(), strict=True):
            out.append(combine(fingerprint(raw[a:b]), (0, 0), after))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array([h[0] for h in out], pa.int64()), pa.array([h[1] for h in out], pa.int64())], names=["row", "size", "h0", "h1"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, fp, text, first) to (row, fp, same): streams both texts past each other in chunks."""
    for batch in batches:
        (at, a), (bt, b) = utf8(batch.column(2)), utf8(batch.column(3))
        same = []
        for i in range(batch.num_rows):
            x, y = a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]
            same.append(len(x) == len(y) and all(np.array_equal(x[k : k + CHUNK], y[k : k + CHUNK]) for k in range(0, len(x), CHUNK)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_())], names=["row", "same"])


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """`docs` with fp: size and fingerprint of the text, null as empty."""
    docs = docs.select(*(c for c in docs.columns if c != "text"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    plain = docs.where(size <= huge).mapInArrow(_hash_rows, docs.withColumn("fp", F.lit("")).schema)
    large = save(docs.where(size > huge).withColumn("row", F.monotonically_increasing_id()), "huge-texts")
    raw = large.select("row", F.col("text").cast("binary").alias("b"))
    n = F.octet_length("b")
    starts = F.explode(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(huge // 2)))
    cut = raw.select("row", "b", starts.alias("at"))
    cut = cut.select("row", F.greatest(n - F.col("at") - huge // 2, F.lit(0)).cast("bigint").alias("after"), F.substring("b", F.col("at") + 1, F.lit(huge // 2)).alias("chunk"))
    hashed = cut.repartition("row", "after").mapInArrow(_hash_chunks, "row bigint, size bigint, h0 bigint, h1 bigint")
    total = hashed.groupBy("row").agg(F.sum("size").alias("n"), *((F.sum(f"h{i}") % PRIME).alias(f"h{i}") for i in (0, 1)))
    name = F.format_string("%x.%08x%08x", "n", "h0", "h1")
    composed = large.join(total.select("row", name.alias("fp")), "row")
    return plain.unionByName(composed.select(*plain.columns))


def _groups(light: DataFrame) -> DataFrame:
    """(fp, share, top, n) of every share of each group of (fp, share, doc_id) of two rows or more; top.doc_id is the one that stays."""
    top = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")
    shares = light.groupBy("fp", "share").agg(F.max(top).alias("top"), F.count(F.lit(1)).alias("n"))
    whole = shares.groupBy("fp").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where("n > 1")
    return shares.select("fp", "share").join(whole, "fp")


def _decided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` (fp, share, doc_id) with keep_id, group_size and kept."""
    # Merging, whatever the sizes: plans and their cost are the same for small and large tables.
    out = rows.join(groups.hint("merge"), ["fp", "share"], "left")
    nth = F.row_number().over(Window.partitionBy("fp", "share", "doc_id").orderBy("doc_id"))  # rows may tie in text and doc_id
    single = F.col("n").isNull()
    out = out.withColumn("kept", single | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (nth == 1)))
    return out.withColumn("keep_id", F.when(single, F.col("doc_id")).otherwise(F.col("top.doc_id"))).withColumn("group_size", F.coalesce("n", F.lit(1)).cast("bigint")).drop("top", "n")


def exact_duplicates(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """`docs` with fp, keep_id (the largest doc_id of equal texts), group_size and kept."""
    given = [c for c in docs.columns if c not in ADDED]
    rows = fingerprints(docs.select(given), huge).withColumn("share", salt(SALTS, "doc_id"))
    groups = save(_groups(save(rows.select("fp", "share", "doc_id"), "fingerprints")), "groups")
    # The number is written once: it names the rows of this table.
    placed = save(_decided(rows, groups).withColumn("row", F.monotonically_increasing_id()), "placed")
    copies = placed.where("group_size > 1")
    firsts = copies.where("kept").select("fp", F.col("text").alias("first_text"))
    firsts = groups.select("fp", "share").join(firsts, "fp")  # SALTS rows of a group at most
    facing = copies.where("not kept").select("row", "fp", "share", "text").join(firsts.hint("merge"), ["fp", "share"])
    differ = save(facing.select("row", "fp", "text", "first_text").mapInArrow(_compare, "row bigint, same boolean").where("not same").select("row"), "collisions")
    if not differ.isEmpty():
        digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        named = placed.join(differ.withColumn("apart", F.lit(True)), "row", "left")
        named = named.withColumn("fp", F.when(F.col("apart"), F.concat("fp", F.lit("."), digest)).otherwise(F.col("fp"))).drop("apart", "keep_id", "group_size", "kept")
        named = save(named, "told-apart")
        placed = _decided(named, _groups(named))
    return placed.select(*given, "fp", "keep_id", "group_size", "kept")

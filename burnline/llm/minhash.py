"""Operator 4: near-duplicates by one-permutation MinHash, banding and star-shaped candidates.

Each document's set of word shingles is hashed once; the top bits of a hash name
its bin, the least hash of a bin is its value, and optimal densification fills
empty bins from a bin drawn by a hash of (bin, attempt), the same for all
documents. Bands of bins hash into buckets. In each bucket a centre (the member
with the least hash of its id) is the only partner of the others, so candidates
grow with members, not their square. Candidates are confirmed on whole sets.

A star may miss a link between two members that both differ from the centre. So
buckets that still hold several components are searched again: their members'
signatures are compared block by block, the largest component only with the
others; where they agree enough the sets are, and a link that joins two
components goes out to be confirmed as well. A pair of blocks yields fewer links
than it has components.

Documents with equal sets are one class, so copies never meet each other. Classes
are what is linked; a class's set is made again from one of its texts, which its
doc_id and the text's hash name.

Nulls: a null text and one without words have no shingles and link with nothing;
a null doc_id takes its component from those with ids. Repeated rows share their
component; rows that share a doc_id but not a text are documents of their own,
and each takes its component from its own text. An empty table gives no rows.
Other columns are ignored. Very long texts are hashed in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.common import arrow_schema, components, pieces, salt, save, scratch, utf8
from burnline.llm.words import BLOCK, U, hashes, long_hashes, mix

#: Words of a shingle; bins of a signature; bands of rows. At a similarity of 0.75 a pair misses all bands with odds of 1 to 3 in 10**5
#: (simulated, 1,500 pairs for each of five sizes), as bins of one permutation aren't independent.
WORDS, BIN_BITS, BANDS, ROWS = 5, 8, 51, 5
BINS = 1 << BIN_BITS
#: Attempts of densification; a document with few shingles may need many.
ATTEMPTS = 4096
#: The least similarity, percent, that BANDS, ROWS and AGREE are made for.
LEAST = 75
SCHEMA = "doc_id bigint, text_hash bigint, n_shingles bigint, set_a bigint, set_b bigint, bands binary"
KEY = ["n_shingles", "set_a", "set_b"]
#: Equal bins of 255 below which a pair of similarity 0.75 practically never falls (about five standard deviations).
AGREE = 150
#: Members of a bucket in a block; a task compares two blocks.
SHARE = 10_000
#: Shares of a component's classes.
SALTS = 16


def _draws() -> np.ndarray:
    """The bin that each empty bin looks at, attempt by attempt."""
    grid = np.arange(BINS * ATTEMPTS, dtype=U).reshape(BINS, ATTEMPTS)
    return (mix(grid + U(0x5851F42D4C957F2D)) >> U(64 - BIN_BITS)).astype(np.int16)


_cache: dict[str, np.ndarray] = {}
_EDGES = (np.arange(BINS, dtype=U) << U(64 - BIN_BITS)).astype(U)
_STEP = mix(np.arange(1, WORDS + 1, dtype=U)) | U(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of shingle hashes of a text's word hashes, sorted."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:  # the whole sequence is one shingle, told from longer ones by its length
        return mix(np.array([(words * _STEP[:n]).sum() + U(n)], U))
    total = words[: n - WORDS + 1] * _STEP[0]
    for k in range(1, WORDS):
        total += words[k : n - WORDS + 1 + k] * _STEP[k]
    out = mix(total)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins filled by optimal densification."""
    if "draws" not in _cache:
        _cache["draws"] = _draws()
    draws = _cache["draws"]
    at = np.searchsorted(shingle_set, _EDGES)
    full = np.diff(at, append=len(shingle_set)) > 0
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    done = 0
    while len(empty) and done < ATTEMPTS:
        width = min(ATTEMPTS - done, 8 if done == 0 else 64)
        tries = draws[empty, done : done + width]
        hit = full[tries]
        found = hit.any(axis=1)
        source[empty[found]] = tries[found, hit[found].argmax(axis=1)]
        empty = empty[~found]
        done += width
    if len(empty):  # beyond all attempts: the first bin that holds something
        source[empty] = np.flatnonzero(full)[0]
    return shingle_set[at[source]]


def _documents(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of each text, a bounded run of texts at a time."""
    for a, b in pieces(offsets, BLOCK):
        block = raw[offsets[a] : offsets[b]]
        if len(block) > BLOCK:  # one long text
            yield long_hashes(block)
            continue
        starts = offsets[a : b + 1] - offsets[a]
        words, before = hashes(block, starts)
        for i in range(b - a):
            yield words[before[i] : before[i + 1]]


def _brief(sig: np.ndarray) -> bytes:
    return (sig[: BANDS * ROWS] & U(255)).astype(np.uint8).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SCHEMA)
    turn = np.arange(1, ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    band = np.arange(BANDS, dtype=U)[:, None] * U(0xD6E8FEB86659FD93)
    for batch in batches:
        offsets, raw = utf8(batch.column(2))
        out = []
        for words in _documents(raw, offsets):
            s = shingles(words)
            if not len(s):
                out.append((0, 0, 0, None))
                continue
            sig = signature(s)
            again = mix(s + U(0x632BE59BD9B4E019))
            rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
            buckets = mix((mix(rows + turn) + band).sum(axis=1, dtype=U))
            out.append((len(s), int(s.sum(dtype=U).astype(np.int64)), int(again.sum(dtype=U).astype(np.int64)), buckets.astype("<u8").tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to (rep, set, brief, signature); brief has the upper halves of the set's hashes."""
    for batch in batches:
        offsets, raw = utf8(batch.column(1))
        sets = [shingles(w) for w in _documents(raw, offsets)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        brief = pa.array([(s >> U(32)).astype("<u4").tobytes() for s in sets], pa.binary())
        sig = pa.array([_brief(signature(s)) if len(s) else b"" for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), brief, sig], names=["rep", "set", "brief", "signature"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (src, dst), the pairs whose whole sets are similar enough."""
    a = sets.select(F.col("rep").alias("src"), F.col("set").alias("set_a"))
    b = sets.select(F.col("rep").alias("dst"), F.col("set").alias("set_b"))
    m, n = F.size("set_a"), F.size("set_b")
    near = 100 * F.least(m, n) >= percent * F.greatest(m, n)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "src").join(b, "dst").where(near).where(100 * both >= percent * (m + n - both)).select("src", "dst")


def _across(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links that join components of one bucket: the members of block `low` meet those of block `high`, anchors only others."""
        rows = rows.sort_values("anchor", kind="stable")
        sig = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), -1)
        rep, root, block = rows["rep"].to_numpy(), rows["component"].to_numpy().copy(), rows["block"].to_numpy()
        size = np.array([len(x) // 4 for x in rows["brief"]])
        ids = mark = None  # made once a pair agrees enough
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        left, right = np.flatnonzero((block == low) & ~rows["anchor"].to_numpy()), np.flatnonzero(block == high)
        src, dst = [], []
        for k, i in enumerate(left):
            at = right[k + 1 :] if low == high else right
            at = at[(root[at] != root[i]) & (100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i]))]
            at = at[(sig[at] == sig[i]).sum(axis=1) >= AGREE] if len(at) else at
            if not len(at):
                continue
            if ids is None:
                values, flat = np.unique(np.frombuffer(b"".join(rows["brief"]), "<u4"), return_inverse=True)
                ids, mark = np.split(flat, np.cumsum(size)[:-1]), np.zeros(len(values), np.int64)
            mark[ids[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([ids[j] for j in at])], np.concatenate([[0], np.cumsum(size[at])[:-1]]))
            mark[ids[i]] = 0
            for j in at[100 * both >= percent * (size[at] + size[i] - both)]:
                if root[j] != root[i]:
                    src.append(rep[i])
                    dst.append(rep[j])
                    root[root == root[j]] = root[i]
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return run


def near_duplicates(docs: DataFrame, percent: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; `percent` below LEAST would lose links and is refused."""
    if percent < LEAST:
        raise ValueError(f"percent must be {LEAST} or more")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    with scratch(spark):  # signatures and sets are no more needed when classes have their components
        sketches = save(texts.mapInArrow(_sketch, SCHEMA), "sketches")
        marks = save(sketches.select("doc_id", *KEY), "marks", keep=True)
        named = save(_components(texts, sketches, percent), "named", keep=True)
    out = marks.join(named, KEY, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _components(texts: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(KEY, component_id) of every class of equal sets."""
    held = sketches.where("n_shingles > 0 and doc_id is not null").groupBy(*KEY).agg(F.min(F.struct("doc_id", "text_hash")).alias("top"), F.first("bands").alias("bands"))
    # A class's number is written once: it tells classes apart whatever their ids are.
    classes = save(held.select(F.monotonically_increasing_id().alias("rep"), *KEY, "top.doc_id", "top.text_hash", "bands"), "classes")
    buckets = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> substring(bands, i * 8 + 1, 8))")
    spread = classes.select("rep", F.explode(buckets).alias("bucket"))
    order = F.xxhash64("rep")
    centres = spread.groupBy("bucket").agg(F.min(F.struct(order.alias("h"), F.col("rep").alias("rep"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.col("top.rep").alias("centre"))
    members = save(spread.join(centres, "bucket").select("bucket", "centre", "rep"), "members")
    stars = members.where("rep <> centre").select(F.col("rep").alias("src"), F.col("centre").alias("dst")).distinct()
    wanted = members.select("rep").distinct().join(classes.select("rep", "doc_id", "text_hash"), "rep")
    named = ["doc_id", "text_hash"]
    sets = texts.join(wanted, named).groupBy(*named, "rep").agg(F.first("text").alias("text")).select("rep", "text")
    sets = save(sets.mapInArrow(_sets, "rep bigint, set array<bigint>, brief binary, signature binary"), "sets")
    links = save(_confirmed(stars, sets, percent), "links")
    comp = components(links)
    comp = save(_rest(members, sets, links, comp, percent), "components")
    # Classes of one component are dealt to shares first: a component may hold a good part of all classes.
    placed = classes.select(*KEY, "rep", "doc_id").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("share", salt(SALTS, "rep"))
    shares = placed.groupBy("component", "share").agg(F.min("doc_id").alias("least"))
    least = shares.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(shares.select("component", "share").join(least, "component"), ["component", "share"]).select(*KEY, "component_id")


def _rest(members: DataFrame, sets: DataFrame, links: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Components with the links that stars have missed."""
    placed = members.select("bucket", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where("k > 1")
    blocks = lambda n: F.ceil(n / SHARE).cast("int")
    mixed = mixed.select("bucket", "all", F.col("top.component").alias("largest"), blocks(F.col("top.n")).alias("anchors"), blocks(F.col("all") - F.col("top.n")).alias("others"))
    # The blocks of a bucket: first the others, then those of the largest component, which only meet the others. A small bucket is one block.
    anchor, deal, one = F.col("component") == F.col("largest"), F.xxhash64("rep"), F.col("all") <= SHARE
    block = F.when(one, 0).when(anchor, F.col("others") + F.pmod(deal, F.col("anchors"))).otherwise(F.pmod(deal, F.col("others"))).cast("int")
    rows = placed.join(mixed, "bucket").withColumn("block", block).withColumn("anchor", anchor)
    met = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(anchor, F.col("others") - 1).otherwise(F.col("others") + F.col("anchors") - 1)))
    rows = rows.select("bucket", "rep", "component", "block", "anchor", F.explode(met).alias("other"))
    rows = rows.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "component", "block", "anchor")
    rows = rows.join(sets.select("rep", "brief", "signature"), "rep")
    more = rows.groupBy("bucket", "low", "high").applyInPandas(_across(percent), "src bigint, dst bigint")
    more = save(more.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "across")
    if more.isEmpty():
        return comp
    found = save(_confirmed(more, sets, percent), "across-links")
    if found.isEmpty():
        return comp
    return components(links.unionByName(found))

"""Operator 3: near-duplicate vectors by spherical k-means cells and blocked cosines.

Centroids are fitted to a bounded sample; every vector is assigned to its nearest
centroid's cell. Vectors at cosine t or more are at most acos(t) apart, so one
whose distance to the bisector of its own and another cell is greater than that
has no partner there; where it is not, the vector is a guest in that cell (only
in cells before its own, so that each pair meets once). Within a cell, blocks of
vectors of one label are multiplied; links become counts and one link to a root
for each linked vector, never all pairs. Equal vectors are one, with a weight.

Cells grow with the vectors, up to MOST_CELLS; beyond that cells do, and are cut
into more blocks.

Vectors that are null, zero, or hold null or non-finite components link with
nothing, nor do those with a null label or vec_id; vectors of another length link
only with their like. Repeated rows count as vectors of their own, and rows that
share a vec_id but not a vector or label keep links and components of their own.
An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.common import components, save

#: Rows of the sample that centroids are fitted to, at least, and for each cell; vectors to a cell aimed at; most cells; rows of a block.
SAMPLE, FOR_CELL, PER_CELL, MOST_CELLS, BLOCK = 16_384, 8, 4_000, 4_096, 4_096
#: Rows that are compared with all centroids at a time.
STRIP = 512


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[a : a + STRIP] @ c.T).argmax(axis=1) for a in range(0, len(x), STRIP)])
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        empty = size[:, 0] == 0
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
        if empty.any():
            c[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return c


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding, label) to (vec_id, label, raw): the vector as doubles, null if it can't link."""
    for b in batches:
        out = []
        for v, i, label in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            ok = v is not None and i is not None and label is not None and None not in v
            x = np.array(v, np.float64) if ok else np.zeros(0)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "raw"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealt(centroids: np.ndarray, least: float):
    reach = np.sqrt(1 - least * least) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, label, w, raw) to (rep, label, w, raw, dim, cell, home)."""
        for b in batches:
            raw = b.column(3).to_pylist()
            row, cells, homes = [], [], []
            fits = np.array([len(r) == 8 * centroids.shape[1] for r in raw], bool)
            at = np.flatnonzero(fits)
            for lo in range(0, len(at), STRIP):
                part = at[lo : lo + STRIP]
                near = _unit([raw[i] for i in part]) @ centroids.T
                own = near.argmax(axis=1)
                # Centroids that almost coincide have no bisector to speak of: all near them are guests.
                apart = np.sqrt(np.maximum(2 - 2 * (centroids[own] @ centroids.T), 0))
                close = (near.max(axis=1, keepdims=True) - near <= reach * apart) | (apart < 1e-5)
                guest = close & (np.arange(len(centroids)) < own[:, None])
                r, c = np.nonzero(guest)
                row += [*part, *part[r]]
                cells += [*own, *c]
                homes += [True] * len(part) + [False] * len(r)
            other = np.flatnonzero(~fits)
            row, cells, homes = np.array([*row, *other], np.int64), np.array(cells + [0] * len(other), np.int32), homes + [True] * len(other)
            take = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names).take(pa.array(row))
            dim = np.array([len(raw[i]) // 8 for i in row], np.int32)
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(dim), pa.array(cells), pa.array(homes, pa.bool_())], names=["rep", "label", "w", "raw", "dim", "cell", "home"])

    return run


def _linked(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks: for each linked vector its count and the root of its links here."""
        empty = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        one = rows["low"].iloc[0] == rows["high"].iloc[0]
        x, rep, w = _unit(list(rows["raw"])), rows["rep"].to_numpy(), rows["w"].to_numpy()
        a = np.flatnonzero(rows["block"] == rows["low"].iloc[0])
        b = a if one else np.flatnonzero(rows["block"] == rows["high"].iloc[0])
        if not len(a) or not len(b):
            return empty
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for lo in range(0, len(a), 512):
            i, j = np.nonzero(x[a[lo : lo + 512]] @ x[b].T >= least)
            i, j = a[lo + i], b[j]
            keep = i < j if one else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            np.add.at(links, i, w[j])
            np.add.at(links, j, w[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        at = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[at], "links": links[at], "root": rep[[find(i) for i in at]]}) if len(at) else empty

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    raw = vectors.select(F.col("vec_id").cast("bigint"), "embedding", F.col("label").cast("int"))
    rows = save(raw.mapInArrow(_raw, "vec_id bigint, label int, raw binary"), "vectors")
    held = rows.where("raw is not null").groupBy("label", "raw").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("w"))
    # The number of a distinct vector is written once: it tells vectors apart whatever their ids are.
    distinct = save(held.select(F.monotonically_increasing_id().alias("rep"), "label", "w", "raw", "vec_id"), "distinct-vectors")
    n = distinct.count()
    dim = distinct.groupBy(F.octet_length("raw").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    centroids = np.ones((1, 1))
    if dim:
        cells = min(MOST_CELLS, -(-n // PER_CELL))
        most = max(SAMPLE, FOR_CELL * cells)  # MOST_CELLS * FOR_CELL rows at most
        sample = distinct.where(F.octet_length("raw") == dim[0].d).orderBy(F.xxhash64("raw"), "rep").limit(most).select("raw").collect()
        x = _unit([bytes(r.raw) for r in sample])
        centroids = spherical_kmeans(x, max(1, min(cells, len(x) // 4)))
    dealt = distinct.select("rep", "label", "w", "raw").mapInArrow(_dealt(centroids, least), "rep bigint, label int, w bigint, raw binary, dim int, cell int, home boolean")
    dealt = save(dealt, "cells")
    key = ["label", "dim", "cell"]
    sizes = dealt.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("homes"), F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK).cast("int").alias("guests"))
    # Blocks of a cell: its homes first, then its guests. A home meets every block, a guest the homes.
    placed = dealt.join(sizes, key).withColumn("block", F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("rep"), F.col("guests"))).cast("int"))
    met = F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("guests") - 1).otherwise(F.col("homes") - 1))
    placed = placed.where("homes > 0").withColumn("other", F.explode(met)).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    links = save(placed.select(*key, "low", "high", "block", "rep", "w", "raw").groupBy(*key, "low", "high").applyInPandas(_linked(least), "rep bigint, links bigint, root bigint"), "vector-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = distinct.join(counts, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = known.join(named, "component").select("label", "raw", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.join(known, ["label", "raw"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

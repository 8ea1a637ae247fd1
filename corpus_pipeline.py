"""Corpus pipeline: documents in, packed token sequences out.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and works on
all rows that its predecessor kept. `run` writes each stage's result to the shared
folder and reads it back for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnline.llm.common import bound_batches, save, scan, scratch
from burnline.llm.exact_dedup import exact_duplicates
from burnline.llm.minhash import near_duplicates
from burnline.llm.packing import pack
from burnline.llm.secret_scan import learn, redacted
from burnline.llm.toxicity import scored, train

#: The whole pipeline trains models and follows links, which SQL can't say; tests hold it against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that none of their names can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*([c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])).alias("_rest"))


def _together(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as they were before `_apart`."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    A null or empty text has the bias alone for a score, and stays where most labels are clean. Repeated rows and ids
    are scored each; an empty table stays empty; extra columns pass."""
    model = train(docs, scan(spark, sf_dir, "labels"))
    return _together(scored(_apart(docs), model).where("toxicity < 0.5"), docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one of the largest doc_id.

    Null texts equal empty ones; a row without a doc_id stays only where all of its group have none; of rows that tie in
    both one stays. An empty table stays empty; extra columns pass."""
    bound_batches(spark)
    return _together(exact_duplicates(_apart(docs)).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Rows without a doc_id, and texts without words, stay. Rows that share an id but not a text are documents of their
    own. An empty table stays empty; extra columns pass."""
    bound_batches(spark)
    # Rows are told apart by a number, as a doc_id may repeat with other texts.
    rows = _apart(docs).withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))
    rows = save(rows, "near-rows")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    groups = save(found.where("component_id is not null"), "near-groups")
    several = groups.where("_row <> component_id").select("component_id").distinct()
    members = groups.join(several, "component_id").join(rows.select("_row", "doc_id"), "_row")
    stays = members.groupBy("component_id").agg(F.min_by("_row", F.struct("doc_id", "_row")).alias("stays"))
    gone = members.join(stays, "component_id").where("_row <> stays").select("_row")
    return _together(rows.join(gone, "_row", "left_anti"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by a mark; every document stays, null and empty texts as they are.

    n_chars, where there is one, follows the text. An empty table stays empty; extra columns pass."""
    bound_batches(spark)
    out = redacted(docs, learn(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their place in sequences of 4096.

    A null text packs its end id alone; repeated rows are packed each; an empty table gives no rows; extra columns are left out."""
    bound_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = save(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality rules, line dedup, near dedup, sanitisation, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, what the
stage before has kept. All but the last return the columns of `documents`; a
stage that rewrites a text also sets n_chars. Rows with a null text are rejected
by the first stage, as are empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm.common import BROADCAST_ROWS, Scratch, documents, whole_text
from volumetra.llm.lines import dedup_lines
from volumetra.llm.neardup import judged
from volumetra.llm.packing import pack_documents
from volumetra.llm.pii import sanitise
from volumetra.llm.quality import quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Null and empty texts fail."""
    return _columns(quality(docs).filter("kept").withColumn("text", F.col("clean_text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; one that is left without a word goes.

    A null doc_id sorts first; repeated rows are treated alike.
    """
    return _columns(dedup_lines(docs).filter(F.col("n_removed").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8).

    A row is known by doc_id and text: of two rows with one doc_id, one may go and the other stay. A row without doc_id
    goes where its group has one; a group without any stays whole. Texts without words stay.
    """
    gone = judged(docs, shingle=5, percent=80).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    gone = Scratch(spark, "gone").save(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(whole_text()) == F.col("_key"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced. Null doc_ids and repeated rows are treated alike."""
    return _columns(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; every row has one at least, a null text too."""
    path = public_tokenizers.path
    return pack_documents(docs.select("doc_id", "text"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Packing is no SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

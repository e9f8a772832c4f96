"""From raw documents to token ids, in five stages.

Each stage calls one corpus operator on all documents that the stage before it
kept; between stages the documents are written as Parquet to the shared folder
and read again, which also cuts the lineage: a lost executor costs the running
stage only. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.bpe import encode
from shelfrank.llm.decontaminate import decontaminate
from shelfrank.llm.quality import quality
from shelfrank.llm.queries import QUALITY, table, word_bpe
from shelfrank.llm.simhash_anchors import near_dedup
from shelfrank.llm.substring_dedup import substring_dedup
from shelfrank.session import persist_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality(docs, table(spark, sf_dir, "labels"), carry=True).where(F.col("score") >= QUALITY).select("doc.*", "text").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.
    Repeated rows stay once, different texts under one id all; documents without
    an id cannot stand for a group and stay as they are."""
    found = near_dedup(docs, shingle=3, distance=2)
    first = found.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller id are cut out; other
    text keeps its white space. A document that was cut gets its new length."""
    found = substring_dedup(docs, layout=True, carry=True)
    cut = F.col("n_removed") > 0
    return found.select("doc.doc_id", F.col("kept").alias("text"), "doc.lang", "doc.source",
                        F.when(cut, F.length("kept").cast("bigint")).otherwise(F.col("doc.n_chars")).alias("n_chars"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(F.size("spans") == 0).select("doc.*", "text").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and what they decode to."""
    found = encode(docs.select("doc_id", "text", "lang", "source"), word_bpe, carry=True)
    return found.select(F.col("id").alias("doc_id"), "doc.lang", "doc.source", "n_tokens", "token_ids", "decoded")


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", near_dedup_stage), ("substring dedup", substring_stage),
          ("benchmark decontamination", decontaminate_stage), ("BPE encoding", bpe_stage)]

#: The classifier and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), spark, "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: each stage calls one operator of tidemark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. `run` writes
each stage's result to the shared folder as Parquet, which the next stage reads.

Columns of `documents` may have any names beside doc_id and text. A null doc_id is a document like others, smaller than all ids where
the smallest stays (but the last to stay in a group of similar ones). An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, jaccard_join, packing, quality_rules, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go: null, empty and short texts among them.

    Rows that repeat are judged alike. Without usable labels only the base rules reject.
    """
    rules = quality_rules.fit(docs, common.read(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs.select(F.struct("*").alias("row"), "text"), rules)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the smallest doc_id, of equal ones the smallest hash of the text.

    Of rows that repeat whole, one stays. Texts without words are like no others and stay.
    """
    return jaccard_join.one_of_each(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 100-byte strings that start earlier are cut out; texts of which nothing is left go.

    n_chars is counted anew. Characters that a cut splits go whole. Texts that were empty before stay.
    """
    return suffix_dedup.without_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Items without words hold none; an empty benchmark lets all stay."""
    scanned = decontaminate.scan(docs, common.read(spark, sf_dir, "benchmark"))
    return scanned.where(F.size("hit_ranges") == 0).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, each with its sequence and offset; a text without tokens is the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_text),
    ("benchmark decontamination", contamination),
    ("best-fit packing", sequences),
]

#: Learned rules, similarity groups and packing are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

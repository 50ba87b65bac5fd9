"""The corpus pipeline: five operators of ``eventloom.llm`` in turn over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last give the columns of ``documents``.

Defined results: a null or empty text fails the base rules, so nothing after the first stage sees one there; a stage
called by itself keeps it where it can't judge it (classifier: by the grade of a document without features; near duplicates
and decontamination: kept; ids: none). A null doc_id is a document like others. Rows that repeat a document are
judged alike and leave near_duplicates as one. A stage that keeps nothing hands on an empty table, and the rest give empty ones. Further
columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import bounded_batches, free_name, stored
from eventloom.llm.decontaminate import leak_columns
from eventloom.llm.jaccard import one_of_each_group
from eventloom.llm.ordinal import classify
from eventloom.llm.pieces import with_ids
from eventloom.llm.qualityrules import quality_columns
from eventloom.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or reads less like trusted text than the threshold."""
    return quality_columns(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are unlikely to be of the best grade, toxic ones among them."""
    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component at a similarity of 0.8 on five-word shingles: that of the
    smallest (doc_id, hash of the text), null ids last. Rows of one id with unlike texts are documents of their own."""
    return one_of_each_group(docs, width=5, percent=80).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer."""
    name = free_name(docs.columns, "_leaks")
    return leak_columns(docs, table(spark, sf_dir, "benchmark"), name=name).where(F.size(name) == 0).select(docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's merge-dropout segmentation, and whether they decode to its text."""
    bounded_batches(spark)
    coded = with_ids(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: hashed n-grams, a trained classifier and tokenizer ids have no SQL form; tests hold the stages to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

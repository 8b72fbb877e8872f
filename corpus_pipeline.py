"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and hands what it reads back to the next stage. All but the last return the columns
of documents. Stages set the session to small Arrow batches, as their rows are whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import line_dedup, near_dedup, packing, quality_model, quality_rules
from tesserae.llm.common import for_texts, own_name, staged, table
from tesserae.llm.queries import tokenizer_path

NEAR_PERCENT = 80


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy rejects go."""
    for_texts(spark)
    return quality_rules.keep_passing(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it is trained on labelled rows of the raw documents."""
    raw = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model.train(raw, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_model.keep_good(docs, model)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line already has go, and with them documents that have no word left (later copies)."""
    for_texts(spark)
    gone = own_name(docs, "_gone")
    left = line_dedup.drop_duplicate_lines(docs, removed=gone)
    return left.filter((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(gone)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; five-word shingles, similarity of 0.8 or more."""
    for_texts(spark)
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    for_texts(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]

#: Encoding and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

"""The corpus pipeline: documents in, token ids of the mixed training set out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from changelens.llm.common import documents, small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.accepted(docs, quality_classifier.trained(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints (three words, three bits): the smallest doc_id."""
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size; a document may come several times, or not at all."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (and what they decode to, as a digest), in the order of the mix."""
    small_batches(spark)
    rows = bpe.encode_documents(docs)
    return rows.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: The classifier's compressed sizes and the token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

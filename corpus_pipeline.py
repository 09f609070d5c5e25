"""A corpus pipeline: good documents, one of each near-duplicate group, without personal data, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents. `run` writes each stage's rows as Parquet in the folder that
spark.checkpoint.dir names and reads them again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import common, mixing, neardup, packing, pii, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates stays."""
    return neardup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, is masked in the texts."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins and texts."""
    return packing.pack(docs, texts=True)


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: Learned scores, random rounding and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = common.shared_folder(spark)
    folder = f"{shared}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

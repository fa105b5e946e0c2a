"""A corpus pipeline of the training-data operators: documents in, token shards out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, mixing, quality, simhash, token_store
from quillgraph.llm.common import bound_batches, read, remove, shared_path
from quillgraph.llm.queries import tokenizer

#: Present tokens of each domain that the mixture keeps.
FACTORS = {"low": 0.5, "toxic": 0.5, "clean": 1.0}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    bound_batches(spark)
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are thinned to the target weights of their domains."""
    bound_batches(spark)
    return mixing.thin(docs, read(spark, sf_dir, "labels"), FACTORS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token shards, read back by document."""
    bound_batches(spark)
    return token_store.tokenize(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-id output", token_stage),
]

#: A convolutional network, fitted rates and a tokenizer can't be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = shared_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            remove(spark, last)
        last = out
    return docs

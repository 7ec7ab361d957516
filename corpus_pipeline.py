"""The training-text pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from certlake.llm import exact, mixing, packing, simhash, toxicity
from certlake.session import shared_dir


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.scored(docs, toxicity.fit(docs, labels))
    return scored.where(scored["score"] < toxicity.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each time that one is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can't express the stages (a trained model, XXH64, a tokenizer); tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the cluster's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

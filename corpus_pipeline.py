"""The corpus pipeline: each stage reads what the one before it wrote.

All stages take documents ``(doc_id, text, lang, source, n_chars)`` and decide by row, so repeated and null ids change
nothing but which of equal rows counts as the first. Null text is empty. Texts are read whole, however long. Further
columns may have any names; all stages but the last give them back as they were. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, exact_dedup, minhash, mixing, quality
from veilspark.llm.common import remove, shared_dir
from veilspark.llm.queries import tokenizer_path


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality classifier rejects go; empty texts are decided on by the scorer's bias."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the smallest id, null last, of rows that share it the first. All
    null and empty texts are one group."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, chosen in the same way. Texts without words are linked with
    nothing and stay."""
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken twice is there twice. A null source is one of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and digests of the ids and of what they decode to; an empty text has no ids."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_classifier", drop_junk), ("exact_dedup", drop_copies), ("minhash_near_dedup", drop_near_copies), ("mix_sources", mix), ("bpe_encode", encode)]

#: Quality scoring and near-duplicate search are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written as Parquet in the shared folder and read again; what a stage has read is
    then removed, but for the first one's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs = spark.read.parquet(path)
        before = [path]
    return docs

"""A corpus from raw documents: toxic ones out, one of each class of near
duplicates, personal data out, sources mixed to target weights, token ids.

Each stage works on all rows its predecessor kept and is written before the
next one reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally.llm import bpe, minhash, mixing, pii, toxicity
from voxtally.llm.common import table
from voxtally.session import scratch_dir

#: The share of all tokens that the mixture may spend.
BUDGET = 0.8


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the held-out fold."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return minhash.one_of_each(docs)


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with labels in place of personal data; ``n_chars``, where there is one, follows the text."""
    clean = pii.redacted(docs)
    if "n_chars" not in clean.columns:
        return clean
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return clean.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.mixed(docs, budget=BUDGET)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``: the ids, and a digest of the bytes they decode to."""
    done = bpe.decode(bpe.encode(docs))
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("private_data", without_private),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: The classifier, the sketch and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The registered queries of these operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.llm import bpe, langid, linededup, minhash, mixing, negatives, packing, pii, topk, toxicity, trie, vectors, warc
from voxtally.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"), cosine=0.98, label_col="label")


@query
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@query
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), langid.FOLDS, langid.HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


@query
def op6_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_products(table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0, k=5)


@query
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf, "pages"))
    return warc.read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_private(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


@query
def op9_near_documents(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_documents(table(spark, sf, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    done = bpe.decode(bpe.encode(table(spark, sf, "documents")))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    kept = linededup.with_kept_text(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = trie.numbered_turns(table(spark, sf, "conversations"))
    return trie.prefix_trie(*trie.with_borrowed_heads(turns))


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)

"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, media, packing, pii_crf, quality_nbsvm, quality_rules, sharding, simhash, toxicity
from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = quality_nbsvm.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality_nbsvm.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", quality_nbsvm.held_out().alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_texts(spark, sf_dir), keep=["doc_id"])


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.detect(_texts(spark, sf_dir), keep=["doc_id"])


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_texts(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(_texts(spark, sf_dir))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"),
        "media_sha256", "feature", "shard", "offset", "width", "height", "bits",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.apply(docs, model, keep=["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    out = langid.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_texts(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, model, keep=["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_nbsvm, op2_byte_bpe, op3_pii_crf, op4_vector_packing, op5_simhash,
        op6_media_columns, op7_toxicity, op8_language_id, op9_sharding, op10_quality_rules,
    )
}

#: None of the ten can be written in SQL as a whole; their tests hold them against brute force,
#: exact round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {}

"""The registered queries of this subpackage: the operators with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywake.llm import (decontaminate, divergence, imatch, langid, neardup, oracle, packing, perspectives, pii,
                         quality, resample, secrets, url_filter, warc)

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), keep_ids=False)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_read(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_read(spark, folder, "documents"))
    counts = [pii.number(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.base_digest(F.col("spans")), "UTF-8"), 256).alias("base_sha256"),
                        pii.all_spans(F.col("spans")).alias("spans"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edited_fingerprints(_read(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_read(spark, folder, "pages")).drop("score")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = perspectives.examples(_read(spark, folder, "conversations"))
    return found.select("conv_id", "perspective", "part", "n_messages", "rendered", F.array_join(F.transform(
        "mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("mask"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, folder, "documents"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, folder, "documents"))
    spans = F.col("spans")
    counts = [secrets.number(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(secrets.written(secrets.base(spans)), "UTF-8"), 256).alias("base_sha256"),
        secrets.written(secrets.reported(spans)).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["owners"] > secrets.OWNERS)).cast("bigint").alias("n_copied"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_read(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_packing": op1,
    "op2_warc": op2,
    "op3_pii": op3,
    "op4_fingerprints": op4,
    "op5_decontamination": op5,
    "op6_url_filter": op6,
    "op7_language_id": op7,
    "op8_quality": op8,
    "op9_perspectives": op9,
    "op10_near_duplicates": op10,
    "op11_resample": op11,
    "op12_secrets": op12,
    "op13_divergence": op13,
    "pipeline": pipeline,
}


def oracle_sql() -> dict[str, str]:
    return oracle.STATEMENTS

"""From raw documents to packed training sequences: each stage's result is written and read as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywake.llm import decontaminate, langid, neardup, packing, pii
from paywake.llm.store import Scratch

#: The rows of run() pass through a tokenizer, trained tables and hashes, which SQL cannot express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Language ID: documents without a recognised language go."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """MinHash near-dedup: the document with the least doc_id of each group stays."""
    return neardup.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark decontamination: documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """PII: spans are replaced by their kind, and n_chars follows."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packing: one row per piece of a document, with its token ids and its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of `sf_dir`; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

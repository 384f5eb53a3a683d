"""The corpus pipeline: documents in five stages, each over all that its predecessor kept.

1. language ID: documents whose language is rejected go;
2. n-gram Jaccard join: of each group of near duplicates the document of least id stays;
3. benchmark decontamination: documents with a benchmark passage go;
4. secret scan: secrets are masked in the text (no document goes);
5. BPE: the remaining texts become tokens.

Each stage is written as Parquet and read again.  Models can't be expressed in SQL,
so ORACLE_SQL is None; tests hold run() against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm import bpe, decontaminate, language_id, ngram_join, secrets, textkit


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.dictionary())


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.load())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("bpe_encoding", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work_dir: str | None = None) -> DataFrame:
    """All stages over documents; stage outputs go to work_dir, by default a new folder in the shared checkpoint folder."""
    if work_dir is None:
        textkit.shared_dir(spark)
        work_dir = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{work_dir}/{k}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: five operators in a row over ``documents``.

Every stage takes the rows its predecessor kept, whole. The first drops documents that are toxic, the second keeps one document of
each class of near duplicates, the third and fourth cut passages out of texts, and the last encodes what is left and decodes it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from galleyproof.llm import common, decontam, neardup, pieces, repeats, spcodec, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, net)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spcodec.round_trip(docs, pieces.default_model())


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("suffix_array_dedup", repeats_out),
    ("benchmark_decontamination", benchmark_out),
    ("sentencepiece_codec", encoded),
]

#: A trained network and suffix arrays are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

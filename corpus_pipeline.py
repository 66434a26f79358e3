"""The corpus pipeline: documents through five operators, each stage on all that the one before kept.

language       documents whose language is rejected go: noise, other scripts, texts without letters; of sf0.01 none does
lines          repeated and nearly repeated lines go from the texts
near_duplicates one document of each group of near-duplicates stays
decontamination documents with passages of the benchmark go
encoding       the texts that are left as token ids, encoded and decoded

All but the last return the columns of documents. SQL can express neither the
language model nor the encoder, so ORACLE_SQL is None and tests compare with a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, decontamination, language, lines, simhash
from scholia.llm.registry import tokenizer_path
from scholia.session import checkpoint_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.deduplicate(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(docs, tokenizer_path(), ids=False))


STAGES = [
    ("language", identify_language),
    ("lines", deduplicate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other is written to the shared checkpoint folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return found
        found.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""The corpus pipeline: quality rules, exact and near dedup, mixing, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of ``documents``; rows that a stage rejects are gone, and
rows that the mix takes twice are there twice. Stages are written and read again between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from gleanery.llm.queries import TOKENIZER
from gleanery.session import freeze_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row the mix took, with a digest of what they decode to."""
    coded = bpe.coded_texts(docs, TOKENIZER, keep=["doc_id", "lang", "source"])
    return coded.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = freeze_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# SQL has no byte-pair encoding; tests hold the rows against a brute-force version.
ORACLE_SQL = None

"""Queries of this package over the test tables, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import alignment, bpe, decontaminate, exact_dedup, filter_audit, lang_id, minhash, mixing, quality_model, quality_rules, sharding, token_files, warc
from gleanery.llm.oracle import ORACLE  # noqa: F401  the SQL twins, by query name
from gleanery.session import scratch_path

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read(spark, sf_dir, "documents"), width=4)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def _fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = _fold(5) == 0
    model = lang_id.learned_from(docs.filter(~held_out).select("text", "lang"))
    labelled = lang_id.label_texts(docs, model)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _fold(4) == 2
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    scored = quality_model.score_texts(read(spark, sf_dir, "documents"), labels, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, TOKENIZER)
    back = token_files.read_tokens(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.coded_texts(read(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"])
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_columns(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_pages(read(spark, sf_dir, "pages"), folder)
    # Each kind of record by its own scan: the type is judged by headers, and payloads of
    # records that the scan does not return are passed by.
    responses = warc.read_archives(spark, folder).filter(F.col("record_type") == "response")
    revisits = warc.read_archives(spark, folder, payload=False).filter(F.col("record_type") == "revisit")
    measured = responses.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    number = r"urn:gleanery:page:(-?[0-9]+)$"
    return measured.unionByName(revisits).select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to", number, 1).try_cast("long").alias("refers_to"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(read(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, keep=["doc_id"])
    return aligned.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_quality_model": op5_quality_model,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_alignment": op12_alignment,
    "op13_decontamination": op13_decontamination,
}

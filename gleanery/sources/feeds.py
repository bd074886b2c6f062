"""Landed RSS and Atom feeds as item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions.dates import feed_datetime
from gleanery.functions.urls import feed_address
from gleanery.session import cutoff


def landing_addresses(sources: DataFrame, feed_prefix: str) -> DataFrame:
    """``sources`` (source_type, address) with ``landed_from``, the address to land each from.

    A video channel is landed from its feed, whose address is ``feed_prefix`` plus
    the channel's id.
    """
    is_channel = F.col("source_type") == "video"
    landed = F.when(is_channel, feed_address(F.col("address"), feed_prefix))
    return sources.withColumn("landed_from", F.coalesce(landed, "address"))


def source_list(spark: SparkSession, rows: list[tuple[str, str]], feed_prefix: str) -> DataFrame:
    """The configured sources (source_type, address) with the address to land each from."""
    return landing_addresses(spark.createDataFrame(rows, "source_type string, address string"), feed_prefix)


def _entries(spark: SparkSession, paths: str | list[str], tag: str, schema, **options) -> DataFrame:
    return (
        spark.read.format("xml")
        .options(rowTag=tag, **options)
        .schema(schema)
        .load(paths)
        .select("*", F.col("_metadata.file_path").alias("feed_file"))
    )


def _items(entries: DataFrame, source_type: str, as_of, hours: float, keep: Column) -> DataFrame:
    recent = F.col("published_date") > cutoff(as_of, hours)
    return entries.withColumn("source_type", F.lit(source_type)).filter(recent & keep)


def rss_rows(entries: DataFrame, *more: str) -> DataFrame:
    """Item columns of RSS entries, batch or stream, and the columns ``more`` as they are."""
    return entries.select(
        F.trim("guid._VALUE").alias("id"),
        "title",
        F.coalesce("description", F.lit("")).alias("description"),
        F.trim("link").alias("url"),
        feed_datetime(F.col("pubDate")).alias("published_date"),
        "feed_file",
        *more,
    )


def rss_items(
    spark: SparkSession,
    paths: str | list[str],
    as_of=None,
    hours: float = 24,
    source_type: str = "rss",
) -> DataFrame:
    """Entries of RSS feeds published strictly after ``as_of - hours``, without content."""
    entries = rss_rows(_entries(spark, paths, "item", schemas.RSS_ENTRY))
    return _items(entries, source_type, as_of, hours, F.lit(True))


def atom_items(
    spark: SparkSession,
    paths: str | list[str],
    as_of=None,
    hours: float = 24,
    source_type: str = "video",
    dropped_in_url: str = "shorts",
) -> DataFrame:
    """Entries of channel feeds, one file per channel; an empty channel adds nothing."""
    entries = _entries(spark, paths, "entry", schemas.ATOM_ENTRY, ignoreNamespace="true").select(
        F.trim("videoId").alias("id"),
        "title",
        F.coalesce("group.description", "summary", F.lit("")).alias("description"),
        F.col("link._href").alias("url"),
        feed_datetime(F.col("published")).alias("published_date"),
        "feed_file",
    )
    return _items(entries, source_type, as_of, hours, ~F.col("url").contains(dropped_in_url))

"""Continuous ingest: newly landed files to first-seen rows or into the item table.

Event time must be a zone-aware TIMESTAMP; run the session in UTC so that the cast
from the zone-less column keeps its meaning.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleanery import schemas
from gleanery.operators.latest import first_per_key
from gleanery.session import cutoff
from gleanery.sources.feeds import rss_rows
from gleanery.sources.store import upsert_items


def landed_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """Rows of files as they land under ``path``; for feeds use ``xml`` with ``rowTag``."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def first_seen(
    rows: DataFrame, keys: list[str], event_time: str, late_hours: int = 24
) -> DataFrame:
    """First row of each key; rows later than ``late_hours`` behind the newest are dropped.

    State holds the keys of the last ``late_hours`` only.
    """
    timed = rows.withColumn("event_at", F.col(event_time).cast("timestamp"))
    return (
        timed.withWatermark("event_at", f"{late_hours} hours")
        .dropDuplicatesWithinWatermark(keys)
        .drop("event_at")
    )


def first_seen_stream(
    rows: DataFrame, keys: list[str], event_time: str, path: str, late: str, checkpoint: str, late_hours: int = 24
) -> StreamingQuery:
    """As `first_seen`, with rows that come too late kept apart in ``late`` instead of dropped;
    takes everything landed so far, then stops. Both tables have a column ``batch``.

    A row is late if its time is more than ``late_hours`` before the newest one kept in earlier
    batches. Of the others the first of each key is kept, unless a row with that key and a time
    inside those hours is kept already; a missing time is never late, missing keys are equal.
    A batch reads the kept keys of the last ``late_hours`` and the newest time of the batch
    before it. A batch that is retried replaces what it wrote.
    """
    spark = rows.sparkSession
    newest_path = f"{checkpoint}-newest"
    kept_schema = StructType([*rows.schema.fields, StructField("batch", LongType())])
    newest_schema = StructType([StructField("newest", rows.schema[event_time].dataType), StructField("batch", LongType())])
    time = F.col(event_time)

    def put(df: DataFrame, number: int, folder: str) -> None:
        writer = df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    def take(batch: DataFrame, number: int) -> None:
        if number == 0:
            known, bound = batch.limit(0).select(keys), None
            newest = None
        else:
            before = spark.read.schema(newest_schema).parquet(newest_path).filter(F.col("batch") == number - 1)
            newest = before.first()["newest"]
            bound = None if newest is None else newest - timedelta(hours=late_hours)
            known = spark.read.schema(kept_schema).parquet(path).filter(F.col("batch") < number)
            if bound is not None:
                known = known.filter((time >= F.lit(bound)) | time.isNull())
            known = known.select(keys)
        is_late = F.lit(False) if bound is None else F.coalesce(time < F.lit(bound), F.lit(False))
        put(batch.filter(is_late), number, late)
        order = [F.asc_nulls_last(event_time), F.asc(F.xxhash64(*batch.columns))]
        fresh = first_per_key(batch.filter(~is_late), keys, order)
        held = known.distinct().toDF(*[f"_known{i}" for i in range(len(keys))])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_known{i}")) for i, k in enumerate(keys)])
        put(fresh.join(held, same, "left_anti"), number, path)
        now = spark.read.schema(kept_schema).parquet(path).filter(F.col("batch") == number)
        latest = F.greatest(F.max(time), F.lit(newest).cast(newest_schema["newest"].dataType))
        put(now.agg(latest.alias("newest")), number, newest_path)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything landed so far to the table at ``path``, then stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(items: DataFrame, path: str, checkpoint: str, as_of=None) -> StreamingQuery:
    """Merge everything landed so far into the item table, batch by batch, then stop.

    A batch that is retried after a failure merges to the same table. The item table
    takes one writer at a time.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        upsert_items(batch.sparkSession, path, batch, as_of)

    return (
        items.select(*schemas.ITEM_BATCH.names, "batch_pos")
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# Holds the text of an entry that does not parse.
CORRUPT = "_corrupt"


def rss_stream(spark: SparkSession, path: str, done: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Entries of RSS feeds as they land under ``path``, malformed ones with their text in `CORRUPT`.

    Spark reads a feed up to an entry that is no XML; that entry and what follows it in the file
    come as one row with their text, to be mended and landed again.

    With ``done``, a folder outside of ``path``, files are moved there once they are taken.
    """
    schema = StructType([*schemas.RSS_ENTRY.fields, StructField(CORRUPT, StringType())])
    options = {"rowTag": "item", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if done:
        options |= {"cleanSource": "archive", "sourceArchiveDir": done}
    entries = landed_stream(spark, path, schema, "xml", files_per_batch, **options)
    return entries.select("*", F.col("_metadata.file_path").alias("feed_file"))


def feed_stream(
    entries: DataFrame, path: str, rejects: str, checkpoint: str, as_of=None, hours: float = 24, source_type: str = "rss"
) -> StreamingQuery:
    """Merge the feed entries landed so far into the item table at ``path``, then stop.

    Entries that do not parse, or lack an id, a title, an address or a date, are written to
    ``rejects`` with their feed; a batch that is retried replaces what it wrote. Of two entries
    with one id the later published wins.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = rss_rows(batch, CORRUPT).withColumn("source_type", F.lit(source_type))
        whole = F.col(CORRUPT).isNull()
        for name in ("id", "title", "url", "published_date"):
            whole = whole & F.col(name).isNotNull()
        bad = rows.filter(~whole).select("feed_file", "id", F.col(CORRUPT).alias("text"), F.lit(number).alias("batch"))
        bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects)
        good = rows.filter(whole & (F.col("published_date") > cutoff(as_of, hours)))
        good = good.withColumns({"content": F.lit(None).cast("string"), "transcript": F.lit(None).cast("string")})
        position = F.struct("published_date", "title", "description")
        upsert_items(batch.sparkSession, path, good.withColumn("batch_pos", position), as_of)

    return (
        entries.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

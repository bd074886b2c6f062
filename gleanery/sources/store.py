"""Stored tables as parquet folders: create, look-back scan, upsert and append.

Items lie in one folder per publication day. An upsert rewrites the days that it touches by
Spark's dynamic partition overwrite; a look-back scan reads the days of its window only. Beside
the items lies a key table, in folders by key hash: an entry tells a day under which a key has
been stored. It is only ever appended to.

With a table format that has row-level operations use ``upsert_into``, which leaves the merge
and its commit to that format.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators.merge import last_in_batch, merge_items, upsert_counts
from gleanery.session import as_of_time, cutoff, freeze_table, ntz

DAY = "published_day"
BUCKET = "key_bucket"
BUCKETS = 64
# Key hashes that are broadcast to the scan of the key table: at most 2 million, 16 MB.
HASHES_SENT = 2_000_000
# Rows (a file and a place in it, or the keys of an item) that are broadcast to a scan of texts.
ROWS_SENT = 200_000
# Smallest files, on average, that a batch is written to its days in from where its rows lie: what Spark takes to
# be the cost of opening a file (`spark.sql.files.openCostInBytes`).
FILE_BYTES = 4 << 20
# Items are mostly text and are written more often than read.
PACKED = {"compression": "zstd"}
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder name of a missing day


def _folder(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def create_table(spark: SparkSession, path: str) -> None:
    """An empty table where ``path`` is absent; an existing one is left alone.

    Readers declare their schema, so an empty folder is a table without rows.
    """
    files, location = _folder(spark, path)
    files.mkdirs(location)


def _schema(fields, **more: str) -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], *[f"{n} {t}" for n, t in more.items()]])


def _items(spark: SparkSession, path: str) -> DataFrame:
    create_table(spark, f"{path}/items")
    return spark.read.schema(_schema(schemas.ITEMS.fields, **{DAY: "date"})).parquet(f"{path}/items")


def read_items(spark: SparkSession, path: str, as_of=None, hours: float | None = None) -> DataFrame:
    """Items, or those published at or after ``as_of - hours`` (no upper bound)."""
    items = _items(spark, path)
    if hours is not None:
        start = as_of_time(as_of) - dt.timedelta(hours=hours)
        items = items.filter((F.col(DAY) >= F.lit(start.date())) & (F.col("published_date") >= cutoff(start, 0)))
    return items.drop(DAY)


def key_hash(keys: list[str] = schemas.ITEM_KEYS) -> Column:
    return F.xxhash64(*keys)


def _keys(spark: SparkSession, path: str) -> DataFrame:
    create_table(spark, f"{path}/keys")
    keys = [schemas.ITEMS[name] for name in schemas.ITEM_KEYS]
    return spark.read.schema(_schema(keys, key_hash="long", stored_day="date", **{BUCKET: "int"})).parquet(f"{path}/keys")


def stored_days(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """(keys, stored_day) of the keys of ``batch`` that the table has held, by the key table.

    The hashes of a batch of up to `HASHES_SENT` keys are sent to the scan, where they drop all
    other entries, so the key table is not shuffled; a larger batch is joined by key.
    """
    keys = schemas.ITEM_KEYS
    asked = batch.select(*keys).distinct()
    hashes = asked.select(key_hash().alias("key_hash")).distinct()
    entries = _keys(spark, path)
    if asked.count() <= HASHES_SENT:
        entries = entries.join(F.broadcast(hashes), "key_hash", "left_semi")
    else:
        entries = entries.join(hashes, "key_hash", "left_semi")
    return entries.join(asked, keys, "left_semi").select(*keys, "stored_day").distinct()


def _sent(few: DataFrame) -> DataFrame:
    """A frozen table with a word to Spark whether it goes to the rows that it is joined with."""
    return F.broadcast(few) if few.count() <= ROWS_SENT else few.hint("merge")


def _first_per_key(rows: DataFrame, keys: list[str], order: list[Column], *ordered_by: str) -> DataFrame:
    """The first row of each key in ``order``, an order by the columns ``ordered_by``.

    ``rows`` are read from files that stay as they are. The rows to leave out are found by keys and
    place in their files, so texts are moved only if these are many.
    """
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = placed.select(*keys, *ordered_by, "_file", "_row").withColumn("_number", number)
    others = freeze_table(numbered.filter("_number > 1").select("_file", "_row"), "others")
    return placed.join(_sent(others), ["_file", "_row"], "left_anti").drop("_file", "_row")


def _dealt(batch: DataFrame, last: DataFrame, days: int) -> DataFrame:
    """``last``, the rows of the frozen ``batch`` that count, with their `DAY`.

    Each task writes a file for each of its days. Rows are moved to their days only if these files
    would be small, as with a small batch or one of many days.
    """
    files = batch.select(F.col("_metadata.file_path"), F.col("_metadata.file_size").alias("size")).distinct()
    size = files.agg(F.sum("size").alias("size")).first()["size"]
    dealt = last.withColumn(DAY, F.to_date("published_date"))
    return dealt if size >= FILE_BYTES * days * batch.rdd.getNumPartitions() else dealt.hint("rebalance", DAY)


def upsert_items(spark: SparkSession, path: str, batch: DataFrame, as_of=None) -> DataFrame:
    """Merge ``batch`` (item columns and ``batch_pos``) into the table; returns the counts.

    Keys are looked up in the key table; item texts are read and written for the touched days,
    and those of a small batch or one of many days are moved once to their days.
    A run that dies before its commit changes no item. One that dies within may leave days of
    before beside new ones; applying the batch again gives the same table as an undisturbed run,
    as does applying it twice. The table takes one writer at a time.
    """
    as_of = as_of_time(as_of)
    keys = schemas.ITEM_KEYS
    batch = freeze_table(batch.select(*schemas.ITEM_BATCH.names, "batch_pos"), "batch", **PACKED)
    last = _first_per_key(batch, keys, [F.desc("batch_pos")], "batch_pos")
    placed = last.select(*keys, F.to_date("published_date").alias("stored_day"))
    found = freeze_table(stored_days(spark, path, batch), "found")
    both = placed.select("stored_day").unionByName(found.select("stored_day")).distinct().collect()
    touched = {r["stored_day"] for r in both}  # one row per folder
    if not touched:
        return upsert_counts(found.select(*keys).distinct(), batch)
    items = _items(spark, path)
    days = [day for day in touched if day is not None]
    here = F.col(DAY).isin(days) if days else F.lit(False)
    old = items.filter(here | F.col(DAY).isNull() if None in touched else here).drop(DAY)
    # Of a key left in two days by a run that died, the first stored row counts.
    old = _first_per_key(old, keys, [F.asc("created_at"), F.asc("published_date")], "created_at", "published_date")
    known = old.select(*keys, "created_at").join(found.select(*keys).distinct(), keys, "left_semi")
    known = freeze_table(known, "known")
    counts = freeze_table(upsert_counts(known, batch), "counts")
    merged = merge_items(old, _dealt(batch, last, len(touched)), as_of, keys, schemas.ITEM_VALUES, None, _sent(known))
    merged = merged.withColumn(DAY, F.to_date("published_date"))

    # Entries first: one that tells of a day without the item does no harm.
    fresh = placed.join(found, [*keys, "stored_day"], "left_anti").withColumn("key_hash", key_hash())
    fresh = fresh.select(*keys, "key_hash", "stored_day", F.pmod("key_hash", F.lit(BUCKETS)).cast("int").alias(BUCKET))
    fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{path}/keys")
    _replace_days(spark, merged, f"{path}/items", touched)
    return counts


def _replace_days(spark: SparkSession, merged: DataFrame, path: str, touched: set[dt.date | None]) -> None:
    """Put ``merged`` in place of its days; touched days that it leaves empty are dropped.

    ``merged`` reads these days. Spark writes the new ones beside them and drops the old at its commit.
    """
    filled = {r[DAY] for r in merged.select(DAY).distinct().collect()}
    in_order = merged.sortWithinPartitions(DAY, "published_date").write.options(**PACKED)
    in_order.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    for day in touched - filled:
        files, folder = _folder(spark, f"{path}/{DAY}={_NO_DAY if day is None else day.isoformat()}")
        files.delete(folder, True)


def upsert_into(batch: DataFrame, table: str, as_of=None) -> None:
    """Merge ``batch`` into a catalog table whose format has row-level operations.

    The same rules as `merge_items`: the last of the batch wins, ``created_at`` is kept.
    """
    new = last_in_batch(batch).select(*schemas.ITEM_BATCH.names, ntz(as_of).alias("created_at")).alias("new")
    same = " and ".join(f"{table}.{key} <=> new.{key}" for key in schemas.ITEM_KEYS)
    values = {name: F.col(f"new.{name}") for name in schemas.ITEM_VALUES}
    new.mergeInto(table, F.expr(same)).whenMatched().update(values).whenNotMatched().insertAll().merge()


def append_summaries(summaries: DataFrame, path: str) -> None:
    columns = schemas.SUMMARIES.names
    summaries.select(*columns).write.mode("append").parquet(path)


def read_summaries(spark: SparkSession, path: str, as_of=None, hours: float | None = None) -> DataFrame:
    """Summaries, or those whose item was published at or after ``as_of - hours``."""
    summaries = spark.read.schema(schemas.SUMMARIES).parquet(path)
    if hours is not None:
        summaries = summaries.filter(F.col("article_created_at") >= cutoff(as_of, hours))
    return summaries


def write_digests(digests: DataFrame, path: str) -> None:
    """Digest rows of one run, replacing an earlier run of the same date."""
    (
        digests.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )

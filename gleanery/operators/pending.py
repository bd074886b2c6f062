"""Items that still need a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cutoff


def pending_items(items: DataFrame, summarised: DataFrame, as_of=None, hours: float | None = 24) -> DataFrame:
    """Items of the window without any summary, of whatever age.

    Videos qualify with a transcript only (an empty one will do). ``summarised``
    holds (source_type, source_id), repeated or not.
    """
    if hours is not None:
        items = items.filter(F.col("published_date") >= cutoff(as_of, hours))
    items = items.filter((F.col("source_type") != "video") | F.col("transcript").isNotNull())
    keys = summarised.select("source_type", F.col("source_id").alias("id"))
    return items.join(keys, ["source_type", "id"], "left_anti")


def source_counts(rows: DataFrame, source_types: list[str]) -> DataFrame:
    """(source_type, items) with a zero row for each listed source that has none."""
    listed = rows.sparkSession.createDataFrame([(s,) for s in source_types], "source_type string")
    zero = listed.select("source_type", F.lit(0).cast("long").alias("one"))
    ones = rows.select("source_type", F.lit(1).cast("long").alias("one"))
    return ones.unionByName(zero).groupBy("source_type").agg(F.sum("one").alias("items"))

"""Upsert of a batch into the item table, as plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.latest import latest_per_key
from gleanery.schemas import ITEM_KEYS, ITEM_VALUES
from gleanery.session import ntz


def last_in_batch(batch: DataFrame, keys: list[str] = ITEM_KEYS, position: str = "batch_pos") -> DataFrame:
    """One row per key: the one that came last in the batch."""
    return latest_per_key(batch, keys, [F.desc(position)])


def merge_items(
    target: DataFrame,
    batch: DataFrame,
    as_of=None,
    keys: list[str] = ITEM_KEYS,
    values: list[str] = ITEM_VALUES,
    position: str | None = "batch_pos",
    known: DataFrame | None = None,
) -> DataFrame:
    """The table after the batch: listed values overwritten, ``created_at`` kept, new keys added.

    A value that is null in the batch overwrites too, as the batch row decides alone. Without a
    ``position`` the batch has one row per key. ``known``, (keys, created_at) of the rows of
    ``target`` that the batch overwrites, may be given where it has been looked up: rows of
    ``target`` stay where they are if it is small.
    """
    new = batch if position is None else last_in_batch(batch, keys, position)
    if known is None:
        known = target.select(*keys, "created_at").join(new.select(*keys), keys, "left_semi")
    kept = target.join(known.select(*keys), keys, "left_anti").select(*keys, *values, "created_at")
    dated = new.select(*keys, *values).join(known, keys, "left")
    return kept.unionByName(dated.withColumn("created_at", F.coalesce("created_at", ntz(as_of))))


def upsert_counts(target: DataFrame, batch: DataFrame, keys: list[str] = ITEM_KEYS) -> DataFrame:
    """(source_type, inserted, updated). A second copy of a new key counts as updated."""
    copies = batch.groupBy(*keys).agg(F.count("*").alias("copies"))
    known = target.select(*keys, F.lit(1).alias("known"))
    new_keys = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0))
    return (
        copies.join(known, keys, "left")
        .groupBy("source_type")
        .agg(
            new_keys.alias("inserted"),
            (F.sum("copies") - new_keys).alias("updated"),
        )
    )

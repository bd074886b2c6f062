"""First rows of each key in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(
    rows: DataFrame, keys: list[str], order: list[Column], n: int = 1, number: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their place as ``number`` if named.

    The filter on ``row_number()`` lets Spark cut every key to ``n`` rows per task
    before the shuffle, so a hot key sends no more rows than a rare one.
    """
    place = number or "_place"
    at = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn(place, F.row_number().over(at)).filter(F.col(place) <= n)
    return first if number else first.drop(place)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in ``order``."""
    return first_per_key(rows, keys, order, 1)


def latest_per_source(summaries: DataFrame) -> DataFrame:
    """Newest summary of each source item; ties go to the greater id."""
    return latest_per_key(
        summaries, ["source_type", "source_id"], [F.desc("created_at"), F.desc("id")]
    )

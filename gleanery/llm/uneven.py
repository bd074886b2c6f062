"""Joins of many rows to one row per key, where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to so many rows, those of one key are no burden to a task.
EVEN_ROWS = 1_000_000
# A key with more than this share of the rows is hot; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def join_each(many: DataFrame, one: DataFrame, key: str, rows: int, share: Column | str = "n") -> DataFrame:
    """Inner join of ``many``, with ``rows`` rows, to ``one``: a row per key, and ``share``, the
    number of rows in ``many`` with that key.

    Rows of hot keys stay where they are and meet a broadcast of at most 10,000 rows; all others
    are shuffled by key.
    """
    share = F.col(share) if isinstance(share, str) else share
    if rows <= EVEN_ROWS:
        return many.join(one, key)
    limit = F.lit(max(1, int(rows * HOT_SHARE)))
    hot = one.filter(share > limit)
    cool = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.filter(share <= limit), key)
    return many.join(F.broadcast(hot), key).unionByName(cool)

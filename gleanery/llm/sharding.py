"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered by a total order on their own values, so the number does not depend on
partitions or tasks. A Feistel network permutes 0 .. 4**half - 1; numbers that land at or
beyond the number of rows walk on along their cycle until they land below it, which
permutes 0 .. n - 1. Shard and slot are the remainder and the quotient of that position, so
both follow from a row number alone (`place`), as does the row number from them (`row_of`).

Bounds: rows carry a few numbers, never texts, through the one shuffle by range. The driver
sees one count per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanery.llm.words import whole
from gleanery.session import freeze_table

SHARDS = 40
SEED = 20240104
ROUNDS = 6
# Odd multipliers of the round function, below 2**32 so that products fit 64 bits.
FIRST, SECOND = 2654435761, 2246822519
LOW32 = 0xFFFFFFFF
PARTITION_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    """One key of 32 bits per round, from the seed alone."""
    keys, state = [], seed & LOW32
    for _ in range(rounds):
        state = (state * 1664525 + 1013904223) & LOW32
        keys.append(state)
    return keys


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. rows - 1."""

    rows: int
    seed: int = SEED
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        """Bits of each half; 4**half is at least ``rows`` and below four times it."""
        return max(1, (max(1, self.rows - 1).bit_length() + 1) // 2)

    def _mixed(self, part: np.ndarray, key: int) -> np.ndarray:
        x = (part * np.uint64(FIRST) + np.uint64(key)) & np.uint64(LOW32)
        x ^= x >> np.uint64(15)
        x = (x * np.uint64(SECOND)) & np.uint64(LOW32)
        x ^= x >> np.uint64(13)
        return x & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        keys = round_keys(self.seed, self.rounds)
        if back:
            for key in reversed(keys):
                left, right = right ^ self._mixed(left, key), left
        else:
            for key in keys:
                left, right = right, left ^ self._mixed(right, key)
        return (left << bits) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        numbers = np.asarray(numbers, dtype=np.uint64)
        if numbers.size and int(numbers.max()) >= self.rows:
            raise ValueError("a number is not below the number of rows")
        out = self._once(numbers, back)
        outside = np.flatnonzero(out >= np.uint64(self.rows))
        while outside.size:
            out[outside] = self._once(out[outside], back)
            outside = outside[out[outside] >= np.uint64(self.rows)]
        return out.astype(np.int64)

    def position(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, back=False)

    def number(self, positions: np.ndarray) -> np.ndarray:
        """The inverse of `position`."""
        return self._walk(positions, back=True)


def place(permutation: Permutation, number: int, shards: int = SHARDS) -> tuple[int, int]:
    """Shard and slot of one row number."""
    at = int(permutation.position(np.array([number]))[0])
    return at % shards, at // shards


def row_of(permutation: Permutation, shard: int, slot: int, shards: int = SHARDS) -> int:
    """The row number in one slot of one shard."""
    return int(permutation.number(np.array([slot * shards + shard]))[0])


def number_rows(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with numbers 0 .. n - 1 in ``order`` (nulls first), and n.

    The numbered table is written before its counts are taken, as sampled range bounds may
    differ when a lost task is run again. Rows equal in all of ``order`` are numbered in any
    order; give an order over all columns to make them alike.
    """
    spark = rows.sparkSession
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    dealt = freeze_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    piece = F.shiftright("_at", PARTITION_BITS)
    counts = dealt.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_rows"))
    # One row per range partition: a table of bounded size, in one window and broadcast.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_piece").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    within = F.col("_at").bitwiseAND((1 << PARTITION_BITS) - 1)
    numbered = dealt.join(F.broadcast(starts), piece == F.col("_of"))
    return numbered.select(*rows.columns, (F.col("_start") + within).alias(name)), int(total)


def permuted(number: Column, rows: int, seed: int = SEED) -> Column:
    """Position of each row number, in Arrow batches."""
    permutation = Permutation(rows, seed)

    def positions(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.position(numbers.to_numpy()))

    return F.pandas_udf(positions, T.LongType())(number)


def shard_rows(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Shard and slot of every row: counts of any two shards differ by one at most.

    Returns ``id_column, size, text_crc32, row_number, shard, slot``. Size is the text's UTF-8
    bytes plus 16. A missing text counts as an empty one, a missing id sorts first. Rows with
    the same id are ordered by checksum and size, and then are alike. Of an empty table no
    rows come. Other columns are not read.
    """
    text = whole(text_column)
    slim = docs.select(
        F.col(id_column),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered, total = number_rows(slim, [id_column, "text_crc32", "size"])
    placed = numbered.withColumn("_position", permuted(F.col("row_number"), total, seed))
    return placed.select(
        *slim.columns,
        "row_number",
        F.pmod("_position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_position div {shards}").alias("slot"),
    )

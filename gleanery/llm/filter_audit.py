"""Audit of how filters interact, by a Gray-code walk over their subsets.

1. Each document gets a mask of the filters that it fails. Documents are counted by part and
   mask: the corpus shrinks to at most 2^k cells a part, summed before they are shuffled.
2. Per part the subsets of filters are walked in Gray-code order, one filter toggled at a time.
   Every cell holds a counter of the active filters that it fails; a cell whose counter leaves
   or reaches zero leaves or joins the running survivors. The 2^k survivor counts are stored.
3. A step of any order of the filters is the difference of two stored states, so the k! orders
   cost no further look at the cells, and none at documents.

All parts of a batch are walked at once. A part is one row of 2^k cells by then, whatever share
of the documents it has.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import whole
from gleanery.session import freeze_table

# Orders grow as k!: 8 filters have 40,320.
MOST_FILTERS = 8
NAMES = "ABCDE"
MEASURES = ("docs", "good", "toxic")
_UPPER = string.ascii_uppercase.encode()
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a code point in UTF-8, but for the first


# The five filters over texts -------------------------------------------------------------


def text_failures(raw: bytes) -> int:
    """Bits 0 to 3: under 50 words; under 65 % of the words distinct; over 5 % capitals of all
    code points; any of the signs #$%&*|. An empty text fails the first alone."""
    words = raw.split()
    points = len(raw.translate(None, _LATER_BYTES))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * points) << 2
        | (len(raw.translate(None, b"#$%&*|")) != len(raw)) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [r.as_py() for r in batch.column(2)]
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array([text_failures(r) for r in raws], pa.int32()),
            pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "mask", "digest"])


def failing_masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(id, part, mask) of every row: bit n of the mask for the n-th of `NAMES`.

    Bit 4: the text is identical to that of a row with a smaller id. A missing text is an empty
    one. A row without an id is no smaller one and has none; rows that share an id do not fail
    by each other. A missing part is the empty string.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        whole(text_column).cast("binary").alias("raw"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    judged = freeze_table(rows.mapInArrow(_judged, f"id {kind}, part string, mask int, digest binary"), "judged")
    known = judged.filter("id is not null")
    # Copies meet in an aggregate; the join is on their ids too, so no text is a hot key.
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(16))
    marked = known.join(first, ["id", "digest"], "left").select("id", "part", F.col("mask").bitwiseOR(later).alias("mask"))
    return marked.unionByName(judged.filter("id is null").select("id", "part", "mask"))


def labelled(masks: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``masks`` with the marks ``good`` (quality 1) and ``toxic`` (toxic 1), false without a label.
    Of repeated labels any one that says so counts."""
    marks = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    none = F.lit(False)
    known = masks.filter("id is not null").join(marks, "id", "left")
    known = known.select(*masks.columns, *[F.coalesce(c, none).alias(c) for c in ("good", "toxic")])
    return known.unionByName(masks.filter("id is null").select(*masks.columns, none.alias("good"), none.alias("toxic")))


# The walk ---------------------------------------------------------------------------------


def gray_walk(filters: int) -> Iterator[tuple[int, int]]:
    """(filter toggled, subset then active) over all subsets but the empty one, which comes first."""
    active = 0
    for step in range(1, 1 << filters):
        toggled = (step & -step).bit_length() - 1
        active ^= 1 << toggled
        yield toggled, active


def survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """States of every subset: documents of ``cells`` (part, mask, measure) that pass all of it."""
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, dtype=np.int64)  # active filters that each cell fails
    running = cells.sum(axis=1)
    states = np.empty((1 << filters, cells.shape[0], cells.shape[2]), dtype=np.int64)
    states[0] = running
    active = 0
    for toggled, subset in gray_walk(filters):
        hit = masks[(masks >> toggled) & 1 == 1]
        if subset > active:
            leaving = hit[failing[hit] == 0]
            failing[hit] += 1
            running = running - cells[:, leaving].sum(axis=1)
        else:
            failing[hit] -= 1
            joining = hit[failing[hit] == 0]
            running = running + cells[:, joining].sum(axis=1)
        active = subset
        states[subset] = running
    return states


def steps_of(cells: np.ndarray, names: str) -> Iterator[tuple[str, int, dict[str, np.ndarray]]]:
    """(order, step, columns over parts) of every order of the filters."""
    k = len(names)
    states = survivors(cells, k)
    masks = np.arange(1 << k)
    failing = [cells[:, (masks >> f) & 1 == 1, 0].sum(axis=1) for f in range(k)]
    orders = list(itertools.permutations(range(k)))
    shares = [np.zeros(cells.shape[0], dtype=np.int64) for _ in range(k)]
    for order in orders:
        before = 0
        for f in order:
            shares[f] += states[before][:, 0] - states[before | 1 << f][:, 0]
            before |= 1 << f
    for order in orders:
        before = 0
        for at, f in enumerate(order):
            after = before | 1 << f
            removed = states[before] - states[after]
            yield "".join(names[i] for i in order), at + 1, {
                "kept": states[after][:, 0],
                "removed": removed[:, 0],
                "redundant": failing[f] - removed[:, 0],
                "unique_fails": cells[:, 1 << f, 0],
                "good_lost": removed[:, 1],
                "toxic_lost": removed[:, 2],
                "shapley": shares[f],
            }
            before = after


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(marked: DataFrame, names: str = NAMES) -> DataFrame:
    """part, filter_order, step and the counts of `COUNTS`, for every part, order and step.

    ``marked`` holds part, mask (bit n for the n-th letter of ``names``), good and toxic, a row
    per document. Of a step: kept after it, removed by it, redundant (failing its filter but
    removed before), unique_fails (failing its filter alone), good_lost and toxic_lost of the
    removed, shapley (what its filter removes, summed over all orders). An empty table has no rows.
    """
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters are audited")
    sums = [F.count("*").alias("docs"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")]
    cells = marked.groupBy("part", "mask").agg(*sums)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((batch.num_rows, 1 << len(names), len(MEASURES)), dtype=np.int64)
            for row, listed in enumerate(batch.column(1).to_pylist()):
                for cell in listed:
                    table[row, cell["mask"]] = [cell[m] for m in MEASURES]
            for order, step, columns in steps_of(table, names):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([order] * batch.num_rows, pa.string()),
                        pa.array(np.full(batch.num_rows, step, dtype=np.int32)),
                        *[pa.array(columns[c], pa.int64()) for c in COUNTS],
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return parts.mapInArrow(walk, schema)


def audit_filters(docs: DataFrame, failures: dict[str, Column], part_column: str, good: Column, toxic: Column) -> DataFrame:
    """`audit` of any filters: ``failures`` tells by letter which rows fail; null does not fail."""
    mask = F.lit(0)
    for at, failed in enumerate(failures.values()):
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << at)).otherwise(F.lit(0)))
    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    marks = [F.coalesce(c, F.lit(False)).alias(n) for n, c in (("good", good), ("toxic", toxic))]
    return audit(docs.select(part.alias("part"), mask.alias("mask"), *marks), "".join(failures))


def audit_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source"
) -> DataFrame:
    """`audit` of the five filters of `NAMES` over whole texts."""
    return audit(labelled(failing_masks(docs, id_column, text_column, part_column), labels, id_column))

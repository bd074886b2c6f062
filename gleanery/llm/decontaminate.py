"""Decontamination: test n-grams that occur in training texts, and what is left without them.

1. Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. Every
   `WIDTH` words in a row of a test item are a window; an item of fewer words is one window.
2. The windows are a hash set: words are numbered, a window is a 64-bit hash over its numbers.
   The set is broadcast in slices, of items whose texts have at most `SLICE_BYTES` together
   (an item alone may be larger); the sizes are counted before anything is collected. Each slice
   is one further narrow pass over the rows, so a test set of any size is scanned for.
3. A task numbers the words of a text by the slice, rolls the hash over all its windows and
   verifies each hit number by number: no result rests on a hash.
4. Hit words are marked. Documents with any, or the spans of hit words, can be removed.

Texts never leave their task, and nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import unused

WIDTH = 10
SLICE_BYTES = 16 << 20
# A-Z become small; what is no digit, letter or byte beyond ASCII becomes a blank.
_TABLE = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20
    for byte in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def _rolled(numbers: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` numbers."""
    runs = len(numbers) - width + 1
    values = numbers.astype(np.uint64) + np.uint64(1)
    out = np.full(runs, width, dtype=np.uint64)
    for at in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + values[at : at + runs]
    return out ^ (out >> np.uint64(32))


class Windows:
    """The windows of some items: numbers of their words, and a sorted hash set per length."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        self.known: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        numbers = [
            np.array([self.known.setdefault(w, len(self.known)) for w in words_of(raw)], dtype=np.int32) for _, raw in items
        ]
        self.numbers = np.concatenate([*numbers, np.empty(0, dtype=np.int32)])
        begins = np.concatenate([[0], np.cumsum(list(map(len, numbers)))]).astype(np.int64)
        self.sizes = []
        for size in sorted({min(width, len(n)) for n in numbers if len(n)}):
            of_size = [at for at, n in enumerate(numbers) if min(width, len(n)) == size]
            runs = [_rolled(numbers[at], size) for at in of_size]
            hashes = np.concatenate(runs)
            places = np.concatenate([begins[at] + np.arange(len(r)) for at, r in zip(of_size, runs)])
            owners = np.repeat(of_size, list(map(len, runs)))
            order = np.lexsort((owners, hashes))
            hashes, places, owners = hashes[order], places[order], owners[order]
            keep = ~self._repeated(hashes, places, owners, size)
            self.sizes.append((size, hashes[keep], places[keep], owners[keep]))

    def _repeated(self, hashes: np.ndarray, places: np.ndarray, owners: np.ndarray, size: int) -> np.ndarray:
        """Windows that equal the one before, word by word, of the same item."""
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])])
        at = np.flatnonzero(same)
        for word in range(size):
            at = at[self.numbers[places[at] + word] == self.numbers[places[at - 1] + word]]
        out = np.zeros(len(hashes), dtype=bool)
        out[at] = True
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        numbers = np.array([self.known.get(w, -1) for w in words], dtype=np.int32)
        # Only runs of known words can be windows.
        unknown = np.concatenate([[0], np.cumsum(numbers < 0)])
        for size, hashes, places, owners in self.sizes:
            if len(words) < size:
                continue
            runs = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(runs):
                continue
            rolled = _rolled(numbers, size)[runs]
            first = np.searchsorted(hashes, rolled, side="left")
            maybe = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == rolled)
            if not len(maybe):
                continue
            last = np.searchsorted(hashes, rolled[maybe], side="right")
            for at, low, high in zip(runs[maybe].tolist(), first[maybe].tolist(), last.tolist()):
                here = numbers[at : at + size]
                same = [w for w in range(low, high) if np.array_equal(self.numbers[places[w] : places[w] + size], here)]
                if same:
                    hit[at : at + size] = True
                    found.update(owners[same].tolist())
        return hit, {self.items[i] for i in found}


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _slices(benchmark: DataFrame, item_column: str, text_column: str) -> tuple[DataFrame, str, int]:
    """The items with a slice number, and how many slices: each within `SLICE_BYTES` or one item."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("binary").alias("raw"))
    items = items.filter("length(raw) > 0").distinct()
    key = F.xxhash64("item", "raw")
    total = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    count = max(1, -(-total // SLICE_BYTES))
    while True:
        numbered = items.withColumn("slice", F.pmod(key, F.lit(count)))
        sizes = numbered.groupBy("slice").agg(F.sum(F.octet_length("raw")).alias("size"), F.count("*").alias("n"))
        if sizes.filter((F.col("size") > 2 * SLICE_BYTES) & (F.col("n") > 1)).isEmpty():
            return numbered, "slice", count
        count *= 2


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with ``overlap``, a struct: n_words, n_hit (words inside any occurrence
    of a window), items (ids of the items whose windows occur, sorted as strings) and spans (starts
    and ends of the runs of hit words, counted in words).

    Missing texts have no words and meet nothing; so do empty items. Rows stay as they are,
    repeated ones too. The windows of items without an id count as hits, but list no item.
    """
    spark = docs.sparkSession
    items, column, count = _slices(benchmark, item_column, item_text_column)
    text, overlap = unused(docs.columns, "_raw"), unused(docs.columns, "overlap")
    # Rows pass one slice after another; each adds its items and spans to what is there.
    state = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
    rows = docs.withColumn(overlap, F.lit(None).cast(state)).withColumn(text, F.col(text_column).cast("binary"))
    schema = rows.schema

    for at in range(count):
        listed = items.filter(F.col(column) == at).select("item", "raw").collect()
        held = spark.sparkContext.broadcast([(r["item"], bytes(r["raw"])) for r in listed])
        rows = rows.mapInArrow(_scanner(held, uuid.uuid4().hex, width), schema)
    return rows.drop(text)


_READY: dict[str, Windows] = {}  # the slice that this worker scans for


def _scanner(held, name: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Windows(held.value, width)
        windows = _READY[name]
        for batch in batches:
            before = batch.column(batch.num_columns - 2)
            made = []
            for raw, known in zip(batch.column(batch.num_columns - 1), before):
                words = words_of(raw.as_py() or b"")
                hit, items = windows.scan(words)
                known = known.as_py()
                if known is not None:
                    for span in known["spans"]:
                        hit[span["start"] : span["end"]] = True
                    items = items | set(known["items"])
                made.append(
                    {
                        "n_words": len(words),
                        "n_hit": int(hit.sum()),
                        "items": sorted(i for i in items if i is not None),
                        "spans": [{"start": s, "end": e} for s, e in _runs(hit)] if hit.any() else [],
                    }
                )
            columns = [*batch.columns[:-2], pa.array(made, before.type), batch.columns[-1]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def without_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the runs of words ``spans`` (start, end), each cut from the first byte of its
    first word to the last byte of its last one."""
    places = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    width: int = WIDTH,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``docs`` without the documents that hold a test window (``remove="documents"``), or with their
    texts cut (``remove="spans"``): hit words go, all else stays byte by byte. Columns stay."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    found = find_overlaps(docs, benchmark, width, text_column, item_column, item_text_column)
    overlap = found.columns[-1]
    if remove == "documents":
        return found.filter(F.col(overlap)["n_hit"] == 0).select(*docs.columns)
    # Only texts with hits go through Python again.
    name = unused(found.columns, "_cut")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(batch.num_columns - 1).to_pylist()
            spans = batch.column(batch.num_columns - 2).to_pylist()
            texts = [
                without_spans(r, [(s["start"], s["end"]) for s in o["spans"]]) if o["spans"] else r for r, o in zip(raws, spans)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=batch.schema.names)

    raw = found.withColumn(name, F.col(text_column).cast("binary"))
    changed = raw.mapInArrow(cut, raw.schema)
    kept = [F.col(name).cast("string").alias(c) if c == text_column else F.col(c) for c in docs.columns]
    return changed.select(*kept)

"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

1. A text behind one blank is encoded by both tokenizers. Where tokens of both end at the same
   byte, a group ends; where any token ends, a link does: the two tokens over those bytes overlap.
   So a text has as many links as places where a token ends.
2. Documents are numbered by region and slot. A region is what one task gathers until it holds
   `POSTINGS` postings or 65,536 slots. For each pair of ids it keeps compressed bitmaps of its
   slots: plane 0 marks the documents that hold the pair linked, plane k those whose further
   links of that pair, less one than all, have bit k - 1. A bitmap is a sorted list of slots or
   plain bits, whichever is shorter. Bitmaps of the same region are OR-merged as it closes.
3. A pair's document count is the sum of the popcounts of its planes 0, its link count that of
   all planes by weight. A document is in one region, so nothing is counted twice, and counts
   are summed before they are shuffled.
4. The counts are joined to the postings, which return them to their regions: there each slot
   adds up what its pairs bring, times the links.

A region's postings are bounded, so is what one task holds; a pair has at most a few rows in a
region, so not even the most frequent pair is much of any join. Nothing is collected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.bpe import byte_letters
from gleanery.llm.words import unused
from gleanery.session import freeze_table

SLOTS = 1 << 16
POSTINGS = 3_000_000  # of a region, about 24 MB of numbers
TEXT_BYTES = 2 << 20  # of texts aligned at once, one text at least
ROWS_OUT = 1 << 16
# Longer texts go to the library that does not backtrack; ids are the same.
LONGEST = 1 << 16
_B_BITS, _SLOT_BITS = 24, 16
# The splitting rule of byte-level files, a fixed value of that format.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids and bytes of a byte-level file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        if spec.get("normalizer") or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"]:
            raise ValueError("only byte-level files without normaliser and added blank are read")
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {s: i for s, i in vocab.items() if s not in special}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for string, at in plain.items():
            self.bytes[at] = bytes(byte_of[c] for c in string)
        for string, at in special.items():
            self.bytes[at] = string.encode("utf-8")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # Ids that follow the order of the merges serve as ranks.
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.quick = None
        if made == sorted(made) and splitter.get("use_regex", True):
            ranks = {self.bytes[at]: at for at in plain.values()}
            self.quick = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.quick is not None and len(text) <= LONGEST:
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and bytes of a piece model, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(at) else piece.replace("▁", " ").encode("utf-8")
            for at, piece in enumerate(map(self.model.id_to_piece, range(size)))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Aligner:
    """Both tokenizers with the tables that alignment needs."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteLevel(byte_path), Pieces(piece_path)
        if len(self.a.bytes) >= 1 << 23 or len(self.b.bytes) >= 1 << _B_BITS:
            raise ValueError("vocabularies of up to 8 million entries are aligned")
        self.length_a = np.array([len(b) for b in self.a.bytes], dtype=np.int64)
        self.length_b = np.array([len(b) for b in self.b.bytes], dtype=np.int64)
        ids_a, ids_b = [str(i) for i in range(len(self.a.bytes))], [str(i) for i in range(len(self.b.bytes))]
        # What a token writes into the text of groups: inside one, or as the last of its side.
        self.written = [i + "," for i in ids_a] + [i + "|" for i in ids_a] + [i + "," for i in ids_b] + [i + ";" for i in ids_b]

    def encode(self, raws: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text, none where the text is empty or the bytes of either side differ from it."""
        texts = [r.decode("utf-8", "replace") for r in raws]
        ids_a = [self.a.encode(" " + t) if t else [] for t in texts]
        ids_b = self.b.encode(texts)
        for at, raw in enumerate(raws):
            whole = b" " + raw
            same = bool(raw) and all(
                b"".join(map(table.__getitem__, ids[at])) == whole
                for table, ids in ((self.a.bytes, ids_a), (self.b.bytes, ids_b))
            )
            if not same:
                ids_a[at], ids_b[at] = [], []
        return ids_a, ids_b

    def align(self, raws: list[bytes]) -> Alignment:
        return Alignment(self, *self.encode(raws))


class Alignment:
    """Groups and links of some texts, laid end to end."""

    def __init__(self, tables: Aligner, ids_a: list[list[int]], ids_b: list[list[int]]):
        self.tables = tables
        self.n_a = np.array(list(map(len, ids_a)), dtype=np.int64)
        self.n_b = np.array(list(map(len, ids_b)), dtype=np.int64)
        self.a = np.fromiter((i for ids in ids_a for i in ids), dtype=np.int64, count=int(self.n_a.sum()))
        self.b = np.fromiter((i for ids in ids_b for i in ids), dtype=np.int64, count=int(self.n_b.sum()))
        self.ends_a, self.ends_b = np.cumsum(tables.length_a[self.a]), np.cumsum(tables.length_b[self.b])
        total = int(self.ends_a[-1]) if len(self.ends_a) else 0
        self.in_a, self.in_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        self.in_a[self.ends_a] = True
        self.in_b[self.ends_b] = True
        self.common = self.in_a & self.in_b
        # Links end where a token of either side does.
        places = np.flatnonzero(self.in_a | self.in_b)
        link_a = self.a[(np.cumsum(self.in_a) - self.in_a)[places]] if total else places
        link_b = self.b[(np.cumsum(self.in_b) - self.in_b)[places]] if total else places
        self.pair = (link_a << _B_BITS) | link_b
        last = np.concatenate([[0], self.ends_a])[np.cumsum(self.n_a)]
        self.doc = np.searchsorted(last, places, side="left")
        self.n_links = np.bincount(self.doc, minlength=len(ids_a))
        self.n_groups = np.bincount(np.searchsorted(last, np.flatnonzero(self.common), side="left"), minlength=len(ids_a))

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text; the empty string without tokens."""
        sizes, before = self.n_a + self.n_b, np.cumsum(self.common) - self.common
        group_a, group_b = before[self.ends_a], before[self.ends_b]
        count = int(self.common.sum())
        upto_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=count))])
        upto_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=count))])
        known_a, known_b = len(self.tables.a.bytes), len(self.tables.b.bytes)
        keys = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        keys[np.arange(len(self.a)) + upto_b[group_a]] = self.a + known_a * self.common[self.ends_a]
        keys[np.arange(len(self.b)) + upto_a[group_b + 1]] = self.b + 2 * known_a + known_b * self.common[self.ends_b]
        written, listed = self.tables.written.__getitem__, keys.tolist()
        ends = np.cumsum(sizes).tolist()
        return ["".join(map(written, listed[start:end]))[:-1] for start, end in zip([0, *ends], ends)]

    def postings(self, first_slot: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers of pair and slot, and how many links each stands for."""
        found = np.sort((self.pair << _SLOT_BITS) | (self.doc + first_slot))
        at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.array([], dtype=np.int64)
        return found[at], np.diff(np.concatenate([at, [len(found)]]))


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


# Bitmaps ------------------------------------------------------------------------------


def pack(slots: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Bitmaps of sorted slots, ``sizes`` of them each, and which are bits rather than lists."""
    ends = np.cumsum(sizes)
    highest = slots[ends - 1].astype(np.int64)
    width = 2 * (highest // 16 + 1)  # bytes of the bits, in whole words of two
    dense = width < 2 * sizes
    if not dense.any():
        out = pa.Array.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(slots.tobytes())]
        )
        return out, dense
    parts, raw = [], memoryview(slots.tobytes())
    for at in range(len(sizes)):
        if dense[at]:
            bits = np.zeros(8 * width[at], dtype=np.uint8)
            bits[slots[ends[at] - sizes[at] : ends[at]]] = 1
            parts.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            parts.append(bytes(raw[2 * (ends[at] - sizes[at]) : 2 * ends[at]]))
    return pa.array(parts, pa.binary()), dense


def unpack(bitmaps: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of some bitmaps, and the row that each comes from."""
    at = np.frombuffer(bitmaps.buffers()[1], dtype=np.int32)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    row = np.repeat(np.arange(len(bitmaps)), np.diff(at) // 2)
    listed = ~dense[row]
    slots, rows = [data.view(np.uint16)[listed]], [row[listed]]
    for one in np.flatnonzero(dense):
        found = np.flatnonzero(np.unpackbits(data[at[one] : at[one + 1]], bitorder="little"))
        slots.append(found.astype(np.uint16))
        rows.append(np.full(len(found), one))
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


def planes(keys: list[np.ndarray], links: list[np.ndarray]) -> Iterator[dict[str, pa.Array]]:
    """Columns pair, plane, docs, dense, bits of a region, from its sorted postings."""
    joined, more = np.concatenate(keys), np.concatenate(links)
    order = np.argsort(joined, kind="stable")
    joined, more = joined[order], more[order] - 1
    del order
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        held = joined if plane == 0 else joined[(more >> (plane - 1)) & 1 == 1]
        pair, slots = held >> _SLOT_BITS, (held & (SLOTS - 1)).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else pair
        ends = np.concatenate([starts[1:], [len(pair)]])
        for at in range(0, len(starts), ROWS_OUT):
            some, upto = starts[at : at + ROWS_OUT], ends[at : at + ROWS_OUT]
            bits, dense = pack(slots[some[0] : upto[-1]], upto - some)
            yield {
                "pair": pa.array(pair[some], pa.int64()),
                "plane": pa.array(np.full(len(some), plane, dtype=np.int32)),
                "docs": pa.array(upto - some, pa.int64()),
                "dense": pa.array(dense),
                "bits": bits,
            }


# The operator -------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, the last column, cut so that about TEXT_BYTES come at once."""
    for batch in batches:
        raws = [r or b"" for r in batch.column(batch.num_columns - 1).to_pylist()]
        at = 0
        while at < len(raws):
            to, held = at, 0
            while to < len(raws) and (to == at or held + len(raws[to]) <= TEXT_BYTES):
                held += len(raws[to])
                to += 1
            yield batch.slice(at, to - at), raws[at:to]
            at = to


def _rows(docs: DataFrame, text_column: str, keep: list[str]) -> DataFrame:
    return docs.select(*keep, F.col(text_column).cast("binary").alias(unused(keep, "_text")))


def align_texts(
    docs: DataFrame, byte_path: str, piece_path: str, text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all but the text by default) with n_a, n_b, n_groups, n_links and ``groups``,
    the ids of each group as `a1,a2|b1;a3|b2,b3`. Texts that are missing, empty or not given back
    byte by byte by both tokenizers have no tokens: zeros and an empty string."""
    keep = [c for c in docs.columns if c != text_column] if keep is None else keep
    rows = _rows(docs, text_column, keep)
    new = "n_a long, n_b long, n_groups long, n_links long, groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = aligner(byte_path, piece_path)
        for batch, raws in _pieces(batches):
            found = tables.align(raws)
            counts = [pa.array(c, pa.int64()) for c in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            columns = [*batch.columns[:-1], *counts, pa.array(found.groups(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    out = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(new).fields])
    return rows.mapInArrow(run, out)


def invert(
    docs: DataFrame, byte_path: str, piece_path: str, text_column: str = "text", keep: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Documents and postings, both kept in the shared folder.

    Documents: a struct ``doc`` of the ``keep`` columns, region, slot, n_a, n_b, n_groups, n_links
    and groups_sha256. Postings: region, pair, plane, docs, dense, bits. Both come of one pass.
    """
    import hashlib

    keep = [c for c in docs.columns if c != text_column] if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("doc"), F.col(text_column).cast("binary").alias("raw"))
    new = (
        "slot int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pair long, plane int, docs long, dense boolean, bits binary, region long"
    )
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *T.StructType.fromDDL(new).fields])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = aligner(byte_path, piece_path)
        region, slot = TaskContext.get().partitionId() << 32, 0
        keys, links, held, types = [], [], 0, None

        def batch_of(length: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            columns["region"] = pa.array(np.full(length, region), pa.int64())
            return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(length, types[n]) for n in names], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            for columns in planes(keys, links) if keys else ():
                yield batch_of(len(columns["pair"]), columns)

        for batch, raws in _pieces(batches):
            if types is None:
                types = {f.name: _arrow_type(f.dataType) for f in out.fields[1:]} | {"doc": batch.column(0).type}
            if held >= POSTINGS or slot + len(raws) > SLOTS:
                yield from close()
                region, slot, keys, links, held = region + 1, 0, [], [], 0
            found = tables.align(raws)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
            counts = {n: pa.array(getattr(found, n), pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")}
            slots = pa.array(np.arange(slot, slot + len(raws), dtype=np.int32))
            yield batch_of(len(raws), {"doc": batch.column(0), "slot": slots, "groups_sha256": pa.array(digests, pa.string()), **counts})
            key, count = found.postings(slot)
            keys.append(key)
            links.append(count)
            held += len(key)
            slot += len(raws)
        yield from close()

    both = freeze_table(rows.mapInArrow(run, out), "inverted")
    at = both.filter("pair is null").select("doc", "region", "slot", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return at, both.filter("pair is not null").select("region", "pair", "plane", "docs", "dense", "bits")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[
        kind.simpleString()
    ]


def _weight() -> Column:
    """Links that a bit of a plane stands for."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("plane") - 1, F.lit(0)))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best) of every linked pair; ``best`` where no pair of its id of
    the first tokenizer is in more documents."""
    counts = postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("docs"))).alias("n_docs"), F.sum(F.col("docs") * _weight()).alias("n_links")
    )
    counts = counts.select(
        "pair",
        F.shiftright("pair", _B_BITS).cast("int").alias("a"),
        F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b"),
        "n_docs",
        "n_links",
    )
    counts = freeze_table(counts, "pairs")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(highest, "a").select(*counts.columns, (F.col("n_docs") == F.col("most")).alias("best"))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per slot of a region after another; rows come sorted by region."""
    region, sums = None, None

    def close() -> pa.RecordBatch:
        slots = np.flatnonzero(sums[0])
        columns = {"region": np.full(len(slots), region), "slot": slots.astype(np.int32), "count_sum": sums[0][slots], "n_best": sums[1][slots]}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
        for start, end in zip(cuts, cuts[1:]):
            if at[start] != region:
                if region is not None:
                    yield close()
                region, sums = at[start], np.zeros((2, SLOTS), dtype=np.int64)
            part = batch.slice(start, end - start)
            slots, rows = unpack(part.column(1), part.column(2).to_numpy(zero_copy_only=False))
            for row, name in ((0, 3), (1, 4)):
                np.add.at(sums[row], slots, part.column(name).to_numpy()[rows])
    if region is not None:
        yield close()


def align(
    docs: DataFrame, byte_path: str, piece_path: str, text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """One row per document: struct ``doc`` of the ``keep`` columns (all but the text by default),
    n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair counts the documents that hold it linked; every row is a document of its own,
    repeated rows and rows without an id too. ``count_sum`` adds the counts of a document's links,
    ``n_best`` counts those whose pair no other pair of the same first id exceeds. Texts that are
    missing, empty or not given back byte by byte have no tokens: zeros and no digest.
    """
    numbered, postings = invert(docs, byte_path, piece_path, text_column, keep)
    counted = pair_counts(postings).select("pair", "n_docs", "best")
    brought = postings.join(counted, "pair").select(
        "region",
        "bits",
        "dense",
        (F.col("n_docs") * _weight()).alias("brings"),
        (F.col("best").cast("long") * _weight()).alias("brings_best"),
    )
    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    returned = brought.repartition(pieces, "region").sortWithinPartitions("region")
    sums = returned.mapInArrow(_add_up, "region long, slot int, count_sum long, n_best long")
    found = numbered.join(sums, ["region", "slot"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return found.select("doc", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")

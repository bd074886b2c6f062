"""Token ids in length-delimited binary records, with a separate offset index.

A data file is a header and records; a record is

    length      8 bytes, unsigned
    checksum    4 bytes, of the length, masked
    payload     ``length`` bytes: 1 if the document has an id, its id (8 bytes, signed), ids
    checksum    4 bytes, of the payload, masked

all little-endian. Ids take 2 bytes where the vocabulary allows, else 4. The checksum is
CRC-32, rotated by 15 bits and shifted by a constant as in record formats of that kind, so
that a checksum of data that holds checksums stays sound. The index file has for each record
its offset and the number of ids before it in the file, closed by a record that is none.
A reader can so go to any record, or any run of records, in two reads.

Writing: rows are dealt by range of id and sorted, each task streams its part to a file
under a name of its own, and only files that the manifest names count. The manifest, one row
per file, is written by Spark, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.word_table import WordTable, letters_apart, words_apart
from gleanery.llm.words import whole

MAGIC = b"GLTOKEN1"
HEAD = struct.Struct("<8sII")  # magic, bytes of an id, 0
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
DOC = struct.Struct("<?q")
ENTRY = np.dtype([("offset", "<u8"), ("before", "<u8")])
END_ID = 1
WORDS_KEPT = 800_000  # of each of two generations, about 160 MB in a worker
JOINED_WORDS = 2048  # words that the library encodes in one call
RECORDS_READ = 2048  # records that one row of a read plan stands for
OUTPUT_BYTES = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """Payload of the record at ``at`` and where the next one starts."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or CHECK.unpack_from(data, at + 8)[0] != masked(length):
        raise ValueError(f"damaged length at {at}")
    start = at + 12
    end = start + LENGTH.unpack(length)[0]
    payload = data[start:end]
    if len(payload) != end - start or CHECK.unpack_from(data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload, end + 4


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that Spark and Python can both reach."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri)


# Encoding with the library ------------------------------------------------------------


class Encoder:
    """Ids of whole texts by the tokenizers library.

    ``by_word`` is for tokenizers that drop white space before they split: they encode a text
    as they do its words, and words met before come from a table of bounded size. It is read
    from the tokenizer's file where it is not given; other tokenizers get whole texts.
    """

    def __init__(self, path: str, by_word: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        spec = json.loads(self.model.to_str())
        self.by_word = words_apart(spec) if by_word is None else by_word
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = WordTable(self._joined, letters_apart(spec), WORDS_KEPT)

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        coded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, dtype=self.dtype).tobytes() for c in coded]

    def _joined(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word, many words in one text; where a token starts tells its word."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        for at in range(0, len(words), JOINED_WORDS):
            some = words[at : at + JOINED_WORDS]
            coded = self.model.encode(" ".join(some), add_special_tokens=False)
            begins = np.fromiter(map(itemgetter(0), coded.offsets), dtype=np.int64)
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            cuts = (np.searchsorted(begins, starts) * width).tolist()
            raw = np.array(coded.ids, dtype=self.dtype).tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.words.ids(texts) if self.by_word else self._plain(texts)


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool | None) -> Encoder:
    return Encoder(path, by_word)


# Writing ------------------------------------------------------------------------------


def _write_part(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int | None, by_word: bool | None
) -> Iterator[pa.RecordBatch]:
    batch = next(batches, None)
    if batch is None:
        return
    model = encoder(path, by_word)
    closing = b"" if end_id is None else np.array([end_id], dtype=model.dtype).tobytes()
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    store, root = opened(folder)
    offsets, before, at, tokens = [], [], HEAD.size, 0
    with store.open_output_stream(f"{root}/{name}.tok", buffer_size=1 << 20) as out:
        out.write(HEAD.pack(MAGIC, model.dtype.itemsize, 0))
        while batch is not None:
            for step in range(0, batch.num_rows, 64):
                piece = batch.slice(step, 64)
                ids = model.encode(piece.column(1).to_pylist())
                for doc, coded in zip(piece.column(0).to_pylist(), ids):
                    coded += closing
                    record = frame(DOC.pack(doc is not None, doc or 0) + coded)
                    offsets.append(at)
                    before.append(tokens)
                    out.write(record)
                    at += len(record)
                    tokens += len(coded) // model.dtype.itemsize
            batch = next(batches, None)
    index = np.empty(len(offsets) + 1, dtype=ENTRY)
    index["offset"], index["before"] = [*offsets, at], [*before, tokens]
    with store.open_output_stream(f"{root}/{name}.idx") as out:
        out.write(index.tobytes())
    yield pa.RecordBatch.from_pydict(
        {"part": [part], "name": [name], "records": [len(offsets)], "tokens": [tokens]}
    )


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = END_ID,
    files: int | None = None,
    by_word: bool | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write every document's ids in ascending order of id; returns the manifest as stored.

    A missing text counts as an empty one and has the end id alone; a missing id sorts first;
    rows that repeat an id stand in the order of their texts. Without rows there are no files.
    """
    spark = docs.sparkSession
    pieces = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), whole(text_column).alias("_text"))
    # Dealt by id alone, so that range bounds are drawn from ids; texts only order repeated ids.
    dealt = rows.repartitionByRange(pieces, "_id").sortWithinPartitions("_id", "_text")
    schema = "part long, name string, records long, tokens long"
    written = dealt.mapInArrow(lambda batches: _write_part(batches, folder, tokenizer_path, end_id, by_word), schema)
    written.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, name string, records long, tokens long").parquet(f"{folder}/manifest")


# Reading ------------------------------------------------------------------------------


def _read_part(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = opened(folder)
    for batch in batches:
        for plan in batch.to_pylist():
            first, count = plan["first"], plan["count"]
            with store.open_input_file(f"{root}/{plan['name']}.idx") as file:
                file.seek(first * ENTRY.itemsize)
                entries = np.frombuffer(file.read((count + 1) * ENTRY.itemsize), dtype=ENTRY)
            with store.open_input_file(f"{root}/{plan['name']}.tok") as file:
                magic, width, _ = HEAD.unpack(file.read(HEAD.size))
                if magic != MAGIC or len(entries) != count + 1:
                    raise ValueError(f"{plan['name']} is no token file")
                at = 0
                while at < count:
                    # As many records as fit the output size, one at least.
                    reached = entries["offset"][at] + np.uint64(OUTPUT_BYTES)
                    to = min(count, max(at + 1, int(np.searchsorted(entries["offset"], reached, "right")) - 1))
                    file.seek(int(entries["offset"][at]))
                    data = memoryview(file.read(int(entries["offset"][to] - entries["offset"][at])))
                    docs, ids, place = [], [], 0
                    while place < len(data):
                        payload, place = unframe(data, place)
                        has_id, doc = DOC.unpack_from(payload)
                        docs.append(doc if has_id else None)
                        coded = np.frombuffer(payload, dtype=f"<u{width}", offset=DOC.size)
                        ids.append(coded.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs, pa.int64()),
                            pa.array(entries["before"][at:to].astype(np.int64) + plan["base"]),
                            pa.array([len(i) // 4 for i in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "token_ids"],
                    )
                    at = to


def read_tokens(spark: SparkSession, folder: str, records: int = RECORDS_READ) -> DataFrame:
    """``doc_id, start, n_tokens, token_ids`` of every record: ids before it in all files, and
    its ids as little-endian numbers of four bytes. Checksums are verified.

    Runs of ``records`` records are read as tasks of their own, at their place in the index.
    """
    files = manifest(spark, folder)
    # One row per file: small, so one window over all.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("name", "records", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    firsts = F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(records)))
    plan = based.filter("records > 0").select("name", "base", "records", firsts.alias("first"))
    plan = plan.select("name", "base", "first", F.least(F.lit(records), F.col("records") - F.col("first")).alias("count"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = plan.repartition(tasks, "name", "first")
    return spread.mapInArrow(lambda batches: _read_part(batches, folder), "doc_id long, start long, n_tokens long, token_ids binary")

"""Byte-pair encoding and decoding of whole texts, by the merges of a tokenizer file.

Encoding a word: its symbols form a doubly linked list; the rank of every pair of
neighbours that has a merge lies in a priority queue. The lowest rank, leftmost first, is
taken out and merged; entries whose pair has changed since are stale and skipped. Decoding
joins the vocabulary's strings.

White space never lies inside a token of such a file, so a text is encoded word by word, and
words met before come from a table of bounded size. The file is read once per Python worker
from its path, which must hold on every executor; nothing of it is copied.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.word_table import WordTable, letters_apart
from gleanery.llm.words import unused, whole

# Bytes of output handed over at once.
OUTPUT_BYTES = 8 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others in order from 256 on."""
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    letters, other = [], 256
    for byte in range(256):
        if byte in printable:
            letters.append(chr(byte))
        else:
            letters.append(chr(other))
            other += 1
    return letters


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian numbers of four bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Bpe:
    """One tokenizer file: normaliser, pre-tokenizer and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only plain byte-pair models are read")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("only files without decoder and post-processor are read")
        self.path = path
        self.library = None
        self.steps = [self._step(s) for s in self._parts(spec["normalizer"], "normalizers")]
        split, byte_level = self._parts(spec["pre_tokenizer"], "pretokenizers")
        if split["behavior"] != "Removed" or not split["invert"] or byte_level["use_regex"]:
            raise ValueError("only pre-tokenizers that keep the matches of one pattern are read")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.strings = {i: s for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        longest_first = sorted(self.added, key=lambda s: (-len(s), s))
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.base = max(vocab.values()) + 1
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] * self.base + vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.words = WordTable(lambda words: list(map(self.word, words)), letters_apart(spec))

    @staticmethod
    def _parts(spec: dict, name: str) -> list[dict]:
        return spec[name] if spec["type"] == "Sequence" else [spec]

    @staticmethod
    def _step(spec: dict):
        kind = spec["type"]
        if kind == "NFC":
            return lambda text: text if text.isascii() else unicodedata.normalize("NFC", text)
        if kind == "Lowercase":
            # Letter by letter: no rule for a sigma at the end of a word.
            return lambda text: text.replace("\u03a3", "\u03c3").lower()
        if kind == "Replace" and "Regex" in spec["pattern"]:
            pattern, content = regex.compile(spec["pattern"]["Regex"]), spec["content"]
            return lambda text: pattern.sub(lambda _: content, text)
        raise ValueError(f"normaliser {kind} is not read")

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols of one word after all merges."""
        n, ranks, merged, base = len(symbols), self.ranks, self.merged, self.base
        queue = []
        for at in range(n - 1):
            rank = ranks.get(symbols[at] * base + symbols[at + 1])
            if rank is not None:
                queue.append(rank * n + at)
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, at = divmod(heappop(queue), n)
            left, right = symbols[at], after[at]
            if left < 0 or right >= n:
                continue
            now = ranks.get(left * base + symbols[right])
            if now is None or merged[now] != merged[rank]:
                continue
            new = symbols[at] = merged[rank]
            symbols[right] = -1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                rank = ranks.get(new * base + symbols[beyond])
                if rank is not None:
                    heappush(queue, rank * n + at)
            ahead = before[at]
            if ahead >= 0:
                rank = ranks.get(symbols[ahead] * base + new)
                if rank is not None:
                    heappush(queue, rank * n + ahead)
        return [s for s in symbols if s >= 0]

    def _piece(self, text: str) -> list[int]:
        """Ids of text without added tokens."""
        for step in self.steps:
            text = step(text)
        out: list[int] = []
        inner, last = self.inner, self.last
        for token in self.pattern.findall(text):
            raw = token.encode("utf-8")
            symbols = [inner[b] for b in raw]
            symbols[-1] = last[raw[-1]]
            out += self.merge(symbols)
        return out

    def _by_library(self, word: str) -> bytes:
        """Words with characters that this Python's Unicode version does not assign: whether
        they are letters, and what their lower case is, only the library's own tables tell."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return _packed(self.library.encode(word, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of one run without white space, as little-endian numbers of four bytes."""
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return self._by_library(word)
        if self.special is None or not self.special.search(word):
            ids = self._piece(word)
        else:
            parts = self.special.split(word)
            ids = list(chain.from_iterable([self.added[p]] if p in self.added else self._piece(p) for p in parts))
        return _packed(ids)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return self.words.ids(texts)

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings, with a blank between as there is no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def _mapped(rows: DataFrame, schema: T.StructType, of_batch, weight) -> DataFrame:
    """``rows`` with further columns that ``of_batch`` makes of a slice of rows; slices are cut
    so that about OUTPUT_BYTES are handed over at once."""
    names = [f.name for f in schema.fields[len(rows.columns) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([weight(v) for v in batch.column(batch.num_columns - 1)]) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                reached = (sizes[at - 1] if at else 0) + OUTPUT_BYTES
                to = max(at + 1, int(np.searchsorted(sizes, reached, side="right")))
                piece = batch.slice(at, to - at)
                made = of_batch(piece.column(piece.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *names])
                at = to

    return rows.mapInArrow(run, schema)


def _kept(docs: DataFrame, text_column: str, keep: list[str] | None) -> list[str]:
    chosen = [c for c in docs.columns if c != text_column] if keep is None else keep
    return [c for c in chosen if c not in ("n_tokens", "token_ids", "decoded")]


def encode_texts(docs: DataFrame, path: str, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default but the text), ``n_tokens`` and ``token_ids``,
    the ids as little-endian numbers of four bytes. A missing text counts as an empty one;
    an empty one has no ids. Rows stay as they are otherwise, repeated ones too. A column of
    ``docs`` named as a new one is left out."""
    keep = _kept(docs, text_column, keep)
    text = unused(keep, "_text")
    rows = docs.select(*keep, whole(text_column).alias(text))
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields, *new])

    def of_batch(texts: list[str]) -> list[pa.Array]:
        ids = tokenizer(path).encode(texts)
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _mapped(rows, schema, of_batch, lambda v: 3 * len(v.as_buffer() or b"")).drop(text)


def decode_ids(rows: DataFrame, path: str, ids_column: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded``, the strings of the ids; missing ids decode to an empty text.
    An id that the file does not have is an error."""
    others = [c for c in rows.columns if c not in (ids_column, "decoded")]
    ordered = rows.select(*others, F.coalesce(ids_column, F.lit(b"")).alias(ids_column))
    schema = T.StructType([*ordered.schema.fields, T.StructField("decoded", T.StringType())])

    def of_batch(ids: list[bytes]) -> list[pa.Array]:
        return [pa.array(list(map(tokenizer(path).decode, ids)), pa.string())]

    return _mapped(ordered, schema, of_batch, lambda v: 2 * len(v.as_buffer() or b""))


def coded_texts(docs: DataFrame, path: str, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`encode_texts`, and `decode_ids` of what it gives, in one pass over the rows."""
    keep = _kept(docs, text_column, keep)
    text = unused(keep, "_text")
    rows = docs.select(*keep, whole(text_column).alias(text))
    new = "n_tokens long, token_ids binary, decoded string"
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(new).fields])

    def of_batch(texts: list[str]) -> list[pa.Array]:
        ids = tokenizer(path).encode(texts)
        decoded = list(map(tokenizer(path).decode, ids))
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]

    return _mapped(rows, schema, of_batch, lambda v: 6 * len(v.as_buffer() or b"")).drop(text)

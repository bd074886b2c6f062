import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import alignment as A
from gleanery.llm.queries import BYTE_LEVEL, PIECES, op12_alignment
from tests.llm.helpers import LONG, fixture

LETTERS = None


def tokens(text):
    """(ids, bytes) of each tokenizer, by the libraries alone."""
    global LETTERS
    if LETTERS is None:
        from gleanery.llm.bpe import byte_letters

        first = Tokenizer.from_file(BYTE_LEVEL)
        first.encode_special_tokens = True
        LETTERS = {c: bytes([b]) for b, c in enumerate(byte_letters())}, first, sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters, first, second = LETTERS
    if not text:
        return [], []
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    a = [(i, b"".join(letters[c] for c in first.id_to_token(i))) for i in a]
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, second.id_to_piece(i)) for i in b)]
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(t for _, t in side) == whole for side in (a, b)) else ([], [])


def brute_force(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    found, held = [], defaultdict(set)
    for at, text in enumerate(texts):
        a, b = tokens(text)
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(t) for _, t in side]).tolist()
            spans.append([(i, s, e) for (i, _), s, e in zip(side, [0, *ends], ends)])
        links, low = [], 0
        for i, start, end in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= start:
                low += 1
            other = low
            while other < len(spans[1]) and spans[1][other][1] < end:
                links.append((i, spans[1][other][0]))
                other += 1
        groups, rest = [], [list(spans[0]), list(spans[1])]
        common = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        for end in sorted(common):
            sides = []
            for side in rest:
                upto = next(n for n, s in enumerate(side) if s[2] == end) + 1
                sides.append(",".join(str(i) for i, _, _ in side[:upto]))
                del side[:upto]
            groups.append("|".join(sides))
        for pair in links:
            held[pair].add(at)
        found.append((len(a), len(b), groups, links))
    highest = Counter()
    for (a, _), where in held.items():
        highest[a] = max(highest[a], len(where))
    return [
        (
            n_a,
            n_b,
            len(groups),
            len(links),
            sum(len(held[p]) == highest[p[0]] for p in links),
            sum(len(held[p]) for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in found
    ]


def digests(rows):
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(str((r.doc.doc_id if "doc" in r else r.doc_id, *[r[c] for c in columns])) for r in rows)


@pytest.mark.parametrize("postings,text_bytes", [(3_000_000, 2 << 20), (500, 300)])
def test_fixture_equals_brute_force(spark, monkeypatch, postings, text_bytes):
    # Small bounds close regions within a task, so that counts come from many of them.
    monkeypatch.setattr(A, "POSTINGS", postings)
    monkeypatch.setattr(A, "TEXT_BYTES", text_bytes)
    more = [(100, "▁ a block sign", "en", "a"), (101, "a\x00b <s> </s> <unk> <0x41>", "en", "a"), (102, " lead  and trail ", "en", "a")]
    docs = fixture(spark).unionByName(fixture(spark, more))
    rows = docs.collect()
    got = A.align(docs, BYTE_LEVEL, PIECES).collect()
    assert got[0].doc.asDict().keys() == set(docs.columns) - {"text"}
    want = [str((r.doc_id, *w)) for r, w in zip(rows, brute_force([r.text for r in rows]))]
    assert digests(got) == sorted(want)


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = [str((r.doc_id, *w)) for r, w in zip(rows, brute_force([r.text for r in rows]))]
    assert digests(op12_alignment(spark, small).collect()) == sorted(want)


def test_groups_as_text_and_empty_table(spark):
    rows = A.align_texts(fixture(spark), BYTE_LEVEL, PIECES).collect()
    for r in rows:
        assert (r.n_groups, bool(r.groups)) == (len(r.groups.split(";")) if r.groups else 0, r.n_a > 0)
    docs = fixture(spark).limit(0)
    assert A.align(docs, BYTE_LEVEL, PIECES).collect() == [] == A.align_texts(docs, BYTE_LEVEL, PIECES).collect()


def test_quick_ids_equal_the_library(spark):
    tables = A.aligner(BYTE_LEVEL, PIECES).a
    draw = np.random.default_rng(5)
    odd = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0xA0, 0x85, 0x2028, 0xE9, 0x301, 0x4E2D, 0x1F600, 0x200D, 0x661, 0x2460)]
    texts = ["".join(draw.choice(odd, size=60)) for _ in range(1500)]
    texts += ["it's we'll THEY'RE 'S", "  \n\n \t x", "a" * 700, " " * 300 + "b", "<|endoftext|>", LONG[:50_000]]
    for text in texts:
        assert tables.quick.encode_ordinary(text) == tables.library.encode(text, add_special_tokens=False).ids


def test_a_text_of_a_megabyte_without_white_space():
    found = A.aligner(BYTE_LEVEL, PIECES).align([b"ab7" * 400_000, " ".encode() * 400_000])
    assert found.n_a.min() > 0 and (found.n_links == found.n_a + found.n_b - found.n_groups).all()


def test_bitmaps_round_trip():
    draw = np.random.default_rng(1)
    sets = [np.sort(draw.choice(60_000, size=n, replace=False)) for n in (1, 3, 700, 20_000, 2, 5_000)]
    bits, dense = A.pack(np.concatenate(sets).astype(np.uint16), np.array(list(map(len, sets))))
    assert dense.tolist() == [False, False, False, True, False, True]
    slots, rows = A.unpack(bits, dense)
    for at, one in enumerate(sets):
        assert np.sort(slots[rows == at]).tolist() == one.tolist()
    some, rows = A.unpack(bits.slice(2, 2), dense[2:4])
    assert len(some) == 20_700 and np.bincount(rows).tolist() == [700, 20_000]


def test_planes_hold_documents_and_links(spark):
    docs = spark.createDataFrame([(1, "a a a a a b"), (2, "a b"), (3, "b"), (4, None)], "doc_id long, text string")
    _, postings = A.invert(docs, BYTE_LEVEL, PIECES)
    counts = A.pair_counts(postings)
    docs_of = Counter()
    links = Counter()
    for text in ("a a a a a b", "a b", "b"):
        a, b = tokens(text)
        pairs = Counter((x[0], y[0]) for x, y in zip(a, b))  # one word, one token on both sides
        links += pairs
        docs_of.update(pairs.keys())
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in counts.collect()} == {p: (docs_of[p], links[p]) for p in links}
    assert postings.agg(F.max("plane")).first()[0] >= 2

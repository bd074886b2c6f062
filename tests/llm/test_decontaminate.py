import re

import pytest

from gleanery.llm import decontaminate as D
from tests.llm.helpers import LOWER, PROSE, TEXTS, fixture

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "Noise. " + PROSE[40:160] + "!"),
    (2, "zwei, Worte"),
    (3, None),
    (4, " .. "),
    (5, "naïve İstanbul Σίσυφος é"),
    (6, "zeile MIT wort"),
    (10, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"),
    (None, "### andere zeile hier"),
    (2, "zwei, Worte"),
    (7, "worte"),
    (8, " ".join(["drei"] * 300)),
]
SCHEMA = "item_id long, text string"


def plain(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(text, items, width=10):
    w = plain(text)
    hit, found = set(), set()
    for item, words in ((i, plain(t)) for i, t in items):
        size = min(width, len(words))
        windows = {tuple(words[p : p + size]) for p in range(len(words) - size + 1)} if words else set()
        for p in range(len(w) - size + 1):
            if tuple(w[p : p + size]) in windows:
                hit.update(range(p, p + size))
                found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def doc_rows():
    return [*TEXTS, (30, "start " + PROSE[30:150] + " middle " + "drei " * 40 + "end", "en", "a"), (31, "Worte zwei Worte. zwei", "de", "a")]


@pytest.mark.parametrize("slice_bytes", [16 << 20, 150])
def test_overlaps_equal_brute_force(spark, monkeypatch, slice_bytes):
    # Small slices: items are scanned for in several passes.
    monkeypatch.setattr(D, "SLICE_BYTES", slice_bytes)
    docs, items = fixture(spark, doc_rows()), spark.createDataFrame(ITEMS, SCHEMA)
    got = D.find_overlaps(docs.withColumnRenamed("_text", "overlap"), items)
    assert got.columns == [*["overlap" if c == "_text" else c for c in docs.columns], "overlap_"]
    want = sorted(str((i, *brute_force(t, ITEMS))) for i, t, _, _ in doc_rows())
    assert sorted(str((r.doc_id, r.overlap_.n_words, r.overlap_.n_hit, r.overlap_["items"])) for r in got.collect()) == want


def test_documents_are_removed(spark):
    docs, items = fixture(spark, doc_rows()), spark.createDataFrame(ITEMS, SCHEMA)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    clean = sorted(str(i) for i, t, _, _ in doc_rows() if brute_force(t, ITEMS)[1] == 0)
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_spans_are_removed(spark):
    docs = fixture(spark, [(1, f"Before, it was. {PROSE} After it: zwei (Worte) more.", "en", "a"), (2, "Clean.\n", "en", "a"), (3, None, "en", "a")])
    items = spark.createDataFrame([(1, PROSE), (2, "zwei worte")], SCHEMA)
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, items, remove="spans").collect()}
    assert (cut[2], cut[3]) == ("Clean.\n", None)
    assert cut[1] == "Before, it was. . After it: ) more."
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, remove="words")


def test_equal_hashes_are_told_apart(monkeypatch):
    # With one hash for all windows only the comparison of words decides.
    import numpy as np

    monkeypatch.setattr(D, "_rolled", lambda numbers, width: np.zeros(len(numbers) - width + 1, dtype=np.uint64))
    windows = D.Windows([("a", b"one two three"), ("b", b"two three four"), ("c", b"one two")], width=3)
    hit, items = windows.scan(b"zero one two three five".split())
    assert hit.tolist() == [False, True, True, True, False] and items == {"a", "c"}


def test_empty_tables(spark):
    docs, items = fixture(spark, doc_rows()), spark.createDataFrame(ITEMS, SCHEMA)
    assert D.find_overlaps(docs.limit(0), items).collect() == []
    assert all(r.overlap.n_hit == 0 for r in D.find_overlaps(docs, items.limit(0)).collect())

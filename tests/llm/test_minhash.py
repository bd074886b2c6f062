import numpy as np
import pytest

from gleanery.llm import minhash as M
from tests.llm.helpers import LOWER, TEXTS, fixture, words


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_force(rows, width):
    sets = [(i, shingles(t, width)) for i, t, _, _ in rows]
    part = {i: i for i, _ in sets if i is not None}
    changed = True
    links = []
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    while changed:
        changed = False
        for i, j in links:
            low = min(part[i], part[j])
            if part[i] != low or part[j] != low:
                part[i] = part[j] = low
                changed = True
    return sorted(str((i, len(s), part.get(i), i is None or part[i] == i)) for i, s in sets)


def family(base, count, edits, seed, first):
    draw = np.random.default_rng(seed)
    out = []
    for n in range(count):
        w = base.split()
        for at in draw.choice(len(w), size=int(draw.integers(0, edits)), replace=False):
            w[at] = f"new{draw.integers(10**9)}"
        out.append((first + n, " ".join(w), "en", "a"))
    return out


@pytest.mark.parametrize("width,block,centres", [(4, 512, 8), (5, 16, 1)])
def test_components_equal_brute_force(spark, monkeypatch, width, block, centres):
    # Blocks of 16 make tasks meet parts of a bucket, one centre leaves much to them.
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "CENTRES", centres)
    base = " ".join(f"b{i}" for i in range(180))
    other = " ".join(f"c{i}" for i in range(60))
    rows = [*TEXTS, *family(base, 120, 14, 1, 1000), *family(other, 20, 5, 2, 2000)]
    got = M.near_groups(fixture(spark, rows), width=width).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute_force(rows, width)


def test_sequential_bounds():
    bounds = M.least_matches()
    assert [n for n, _ in bounds] == list(range(M.BATCH, M.HASHES + 1, M.BATCH))
    # The chance to give up a pair of similarity 0.8 at any batch stays small.
    draw = np.random.default_rng(0)
    matches = (draw.random((200_000, M.HASHES)) < 0.8).cumsum(axis=1)
    given_up = np.zeros(len(matches), dtype=bool)
    for n, needed in bounds:
        given_up |= matches[:, n - 1] < needed
    assert given_up.mean() < 1e-3


def test_signatures_estimate_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2400], np.random.default_rng(2).integers(0, 2**63, 600).astype(np.uint64)])
    true = 2400 / 3600
    assert abs((M.signature(a, 1024) == M.signature(np.unique(b), 1024)).mean() - true) < 0.06


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)] + [(7000, 7001)]
    got = {r.id: r.component_id for r in M.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 7000: 7000, 7001: 7000}


def test_dropping_and_empty_table(spark):
    docs = fixture(spark)
    kept = M.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 5, 6, 7, 8, 9, None, 11, 12, 12, 13, 14]))
    assert M.near_groups(docs.limit(0)).collect() == []


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    # Every key counts as hot, or none.
    from gleanery.llm import uneven

    many = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(600)], "k long, v long")
    one = many.groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(tuple(r) for r in many.join(one, "k").collect())
    for rows, share in ((1, 1e-4), (1, 0.2 * 600), (1, 1e9)):
        monkeypatch.setattr(uneven, "EVEN_ROWS", 0)
        monkeypatch.setattr(uneven, "HOT_SHARE", share)
        assert sorted(tuple(r) for r in uneven.join_each(many, one, "k", rows).collect()) == want
    test_components_of_a_chain_and_a_star(spark)

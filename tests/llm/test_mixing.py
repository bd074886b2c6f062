import random
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import mixing
from tests.llm.helpers import TEXTS, fixture, words


def test_targets_are_capped_and_shared_again():
    got = mixing.capped_targets([10, 100, 1000], [3, 1, 2], Fraction(3, 2) * 1110)
    assert got == [20, 200, Fraction(1665) - 220]
    assert mixing.capped_targets([0, 0], [3, 1], Fraction(0)) == [0, 0]
    assert mixing.capped_targets([], [], Fraction(0)) == []


def cheapest_by_unit(patterns, quotas, repeats=2):
    """Least cost by augmenting one word at a time over the residual network (Bellman-Ford)."""
    arcs = []  # from, to, capacity, cost

    def add(a, b, cap, cost):
        arcs.append([a, b, cap, cost])
        arcs.append([b, a, 0, -cost])

    for i, (sources, size) in enumerate(patterns):
        for k in range(repeats):
            add("s", ("p", i), size, (k + 1) ** 2)
        for s in sources:
            add(("p", i), ("q", s), repeats * size, 0)
    for s, q in enumerate(quotas):
        add(("q", s), "t", q, 0)
    flow = cost = 0
    while True:
        best, via = {"s": 0}, {}
        for _ in range(len(patterns) + len(quotas) + 2):
            for n, (a, b, cap, c) in enumerate(arcs):
                if cap > 0 and a in best and best[a] + c < best.get(b, 10**9):
                    best[b], via[b] = best[a] + c, n
        if "t" not in best:
            return flow, cost
        node = "t"
        while node != "s":
            n = via[node]
            arcs[n][2] -= 1
            arcs[n ^ 1][2] += 1
            node = arcs[n][0]
        flow, cost = flow + 1, cost + best["t"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2), min_size=1), st.integers(1, 6)), max_size=4), st.lists(st.integers(0, 8), min_size=3, max_size=3))
def test_flow_is_cheapest(patterns, quotas):
    patterns = [(tuple(sorted(s)), n) for s, n in patterns]
    sent = mixing.cheapest_flow(patterns, quotas)
    used = [sum(row.values()) for row in sent]
    for (sources, size), row in zip(patterns, sent):
        assert set(row) <= set(sources) and sum(row.values()) <= 2 * size
    got = [sum(row.get(s, 0) for row in sent) for s in range(3)]
    assert all(g <= q for g, q in zip(got, quotas))
    cost = sum(sum(max(0, min(u, (k + 1) * n) - k * n) * (k + 1) ** 2 for k in range(2)) for u, (_, n) in zip(used, patterns))
    assert (sum(used), cost) == cheapest_by_unit(patterns, quotas)


def test_mix_of_fixture(spark):
    docs = fixture(spark, [*TEXTS, *[(200 + i, "one two three " * (i % 7), "en", "abc"[i % 3]) for i in range(300)]])
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by_source, sizes = {}, {}
    for r in rows:
        assert r.taken == r.copies * r["size"] and r.copies <= 2 and len(r.served) == r.copies
        by_source.setdefault(r.members[0], []).append(r)
    assert sum(r["size"] for r in rows) == sum(len(words(t.text)) for t in docs.select("text").collect())
    for source, group in by_source.items():
        held = sum(r["size"] for r in group)
        assert {r.source_size for r in group} == {held} and len({r.target for r in group}) == 1
        target = group[0].target
        assert target <= 2 * held + 1e-9
        # Near: within half of what the best single document can mend.
        assert abs(sum(r.taken for r in group) - target) <= max(r["size"] for r in group) / 2 + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_overlapping_sources(spark):
    docs = fixture(spark, [(i, "w " * 10, "en", None) for i in range(90)])
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    rows = mixing.mix(docs, memberships=members, weights={"a": 1, "b": 1}, share=Fraction(1)).collect()
    served = {"a": 0, "b": 0}
    for r in rows:
        for s in r.served:
            assert s in r.members
            served[s] += r["size"]
    assert served == {"a": 450, "b": 450}
    assert all(r.copies == 1 for r in rows)  # nothing is repeated while something is left


def test_rows_and_empty_table(spark):
    docs = fixture(spark).withColumn("_copies", F.lit(1))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.doc_id is not None}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == c for i, c in want.items() if i != 12)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_gaps_of_very_long_texts_are_filled(spark):
    rows = [(i, "w " * (20 + i % 30), "en", "abc"[i % 3]) for i in range(900)]
    rows += [(1000 + i, "w " * 6000, "en", "abc"[i % 3]) for i in range(6)]
    docs = fixture(spark, [*rows, (2000, "w " * 9000, "en", None), *[(2001 + i, "w " * 35, "en", None) for i in range(300)]])
    for seed in ("mix-1", "mix-2"):
        off = {}
        for r in mixing.mix(docs, seed=seed, share=Fraction(4, 5)).collect():
            assert r.copies <= 2 and len(r.served) == r.copies and set(r.served) <= set(r.members)
            off[r.members[0]] = off.get(r.members[0], -r.target) + r.taken
        # One fill for each claim left thousands of words.
        assert all(abs(words) <= mixing.NEAR * 35 for words in off.values())


def test_long_texts_of_overlapping_sources(spark):
    rows = [(i, "w " * (15 + i % 40), "en", None) for i in range(600)]
    docs = fixture(spark, [*rows, *[(1000 + i, "w " * 7000, "en", None) for i in range(4)]])
    members = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    chosen = mixing.mix(docs, memberships=members, weights={"a": 2, "b": 3}, share=Fraction(1, 2)).collect()
    served, asked = {"a": 0, "b": 0}, sum(r["size"] for r in chosen) / 2
    for r in chosen:
        assert r.copies <= 2 and set(r.served) <= set(r.members)
        for s in r.served:
            served[s] += r["size"]
    targets = {r.members[0]: r.target for r in chosen}
    assert abs(served["a"] - targets["a"]) <= mixing.NEAR * 35
    assert abs(served["b"] - asked + targets["a"]) <= mixing.NEAR * 35


def test_rows_without_an_id_or_with_the_same_one(spark):
    rows = [(None if i % 2 else i % 7, f"w{i} " + "w " * (i % 20), "en", "ab"[i % 3 == 0]) for i in range(60)]
    docs = fixture(spark, rows)
    want = sum(r.taken for r in mixing.mix(docs).collect())
    got = mixing.mixed_rows(docs).collect()
    assert sum(len(words(r.text)) for r in got) == want
    assert any(r.doc_id is None for r in got)
    texts = [r.text for r in got]
    assert max(map(texts.count, texts)) <= 2


def test_kept_columns_called_like_inner_ones(spark):
    names = ["size", "members", "target", "copies", "source_size", "taken", "served", "_id", "_row", "_keep0", "claim"]
    docs = fixture(spark).select("doc_id", "text", "source", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
    got = mixing.mix(docs, keep=names)
    want = [n + "_" if n in mixing.MADE else n for n in names]
    assert got.columns == ["doc_id", *mixing.MADE, *want]
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(r[n] == f"x{i}" for r in rows for i, n in enumerate(want))
    plain = mixing.mix(fixture(spark)).collect()
    key = lambda r: (str(r.doc_id), r.copies)
    assert [(r.doc_id, r.copies, r.size) for r in sorted(rows, key=key)] == [
        (r.doc_id, r.copies, r.size) for r in sorted(plain, key=key)
    ]
    sized = mixing.mix(docs.drop("size").withColumnRenamed("doc_id", "size"), id_column="size")
    assert sized.columns[0] == "size_" and sized.count() == len(TEXTS)


def test_flow_over_many_patterns():
    rng = random.Random(7)
    patterns = list({tuple(sorted(rng.sample(range(30), rng.randint(1, 6)))) for _ in range(5000)})
    patterns = [(p, rng.randint(1, 1000)) for p in patterns]
    total = sum(n for _, n in patterns)
    quotas = [total * 3 // 2 // 30] * 30
    sent = mixing.cheapest_flow(patterns, quotas)
    got = [sum(row.get(s, 0) for row in sent) for s in range(30)]
    assert got == quotas
    used = [sum(row.values()) for row in sent]
    assert all(set(row) <= set(p) for (p, _), row in zip(patterns, sent))
    # All quotas can be met, so no word is used a second time before every word is used once.
    assert all(n <= u <= 2 * n for (_, n), u in zip(patterns, used))

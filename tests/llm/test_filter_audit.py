import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import filter_audit as A
from tests.llm.helpers import TEXTS, fixture, words


def failing(rows):
    """Filters that each row fails, by the contract's words."""
    out = []
    for i, text, _, source in rows:
        text = text or ""
        w = words(text)
        bad = ""
        bad += "A" if len(w) < 50 else ""
        bad += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        bad += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
        bad += "D" if any(c in "#$%&*|" for c in text) else ""
        bad += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _, _ in rows) else ""
        out.append((source or "", i, bad))
    return out


def brute_force(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    table = failing(rows)
    out = []
    for part in sorted({p for p, _, _ in table}):
        docs = [(i, bad) for p, i, bad in table if p == part]
        per_order = {}
        for order in itertools.permutations("ABCDE"):
            left, steps = docs, []
            for letter in order:
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                fails = sum(letter in bad for _, bad in docs)
                alone = sum(bad == letter for _, bad in docs)
                lost = [sum(i in marks for i, _ in gone) for marks in (good, toxic)]
                steps.append((len(left), len(gone), fails - len(gone), alone, *lost))
            per_order["".join(order)] = steps
        for order, steps in per_order.items():
            for at, step in enumerate(steps):
                share = sum(s[o.index(order[at])][1] for o, s in per_order.items())
                out.append((part, order, at + 1, *step, share))
    return sorted(out)


LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (8, None, 1), (11, 0, None), (12, 1, 0), (12, 0, 0), (None, 1, 1), (77, 1, 1)]


def test_audit_equals_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    more = [*TEXTS, (20, TEXTS[0][1], "en", ""), (None, "", "en", "q"), (21, "", None, "q"), (22, "A# " * 80, "en", "q")]
    got = A.audit_documents(fixture(spark, more), labels).collect()
    assert len(got) == 600 * len({s or "" for _, _, _, s in more})
    assert sorted(tuple(r) for r in got) == brute_force(more, LABELS)


def test_masks_of_every_row(spark):
    got = A.failing_masks(fixture(spark)).collect()
    letters = sorted(str((r.part, r.id, "".join(c for n, c in enumerate("ABCDE") if r["mask"] >> n & 1))) for r in got)
    assert letters == sorted(str(r) for r in failing(TEXTS))


def test_walk_toggles_one_filter_at_a_time():
    before, seen = 0, {0}
    for toggled, subset in A.gray_walk(5):
        assert before ^ subset == 1 << toggled
        seen.add(subset)
        before = subset
    assert len(seen) == 32


@pytest.mark.parametrize("filters", [1, 3, 6])
def test_states_are_survivors(filters):
    cells = np.random.default_rng(filters).integers(0, 50, (4, 1 << filters, 3))
    states = A.survivors(cells, filters)
    for subset in range(1 << filters):
        passing = [m for m in range(1 << filters) if m & subset == 0]
        assert (states[subset] == cells[:, passing].sum(axis=1)).all()


def test_other_filters_and_empty_tables(spark):
    docs = fixture(spark)
    none = F.lit(None).cast("boolean")
    got = A.audit_filters(docs, {"s": F.length("text") < 100, "n": F.col("lang").isNull()}, "source", none, none).collect()
    assert {r.filter_order for r in got} == {"sn", "ns"} and len(got) == 4 * len({s for _, _, _, s in TEXTS})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_documents(docs.limit(0), labels).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in A.audit_documents(docs, labels).collect())
    with pytest.raises(ValueError):
        A.audit(docs, "ABCDEFGHI")

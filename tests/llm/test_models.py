"""The two learned models: properties on small tables, held-out accuracy on the test tables."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gleanery.llm import lang_id, quality_model, queries
from tests.llm.helpers import TEXTS, fixture

SENTENCES = {
    "de": "der hund und die katze sitzen nicht auf dem alten haus weil es schon wieder regnet",
    "en": "the dog and the cat do not sit on that old house because it rains once more",
}


def tiny_model():
    runs = [(lang, text.split()) for lang, text in SENTENCES.items() for _ in range(8)]
    return lang_id.learn(runs)


def test_marginals_equal_enumeration():
    model = tiny_model()
    words = ["der", "the", "katze", "old"]
    scores = model.emissions(words)
    weights = {}
    for path in itertools.product(range(2), repeat=4):
        total = sum(scores[i, l] for i, l in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
        weights[path] = math.exp(total - 20)
    whole = sum(weights.values())
    want = [[sum(w for p, w in weights.items() if p[i] == l) / whole for l in range(2)] for i in range(4)]
    got = model.marginals(np.concatenate([scores[:2], scores]), np.array([2, 4]))
    assert np.allclose(got[2:], want, atol=1e-4)
    assert np.allclose(got.sum(axis=1), 1)


def test_code_switched_text():
    labels = [l for _, l, _ in lang_id.word_labels("der hund und die katze the dog and the cat 42 !!", tiny_model())]
    assert labels == ["de"] * 5 + ["en"] * 5
    assert lang_id.word_labels("42 !!", tiny_model()) == []


def test_texts_without_letters_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "SLICE_CHARS", 50)
    rows = [*TEXTS, (30, SENTENCES["de"] * 40, "x", "y"), (31, SENTENCES["en"], None, None), (32, "123 456", "en", "a")]
    docs = fixture(spark, rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.label_texts(docs, tiny_model()).collect()}
    assert got[30][0] == "de" and got[31][0] == "en" and got[31][1] > 0.8
    assert {got[i] for i in (5, 6, 7, 32, 11)} == {("und", 0.0)}
    assert lang_id.label_texts(docs.limit(0), tiny_model()).collect() == []
    assert {r.lang_pred for r in lang_id.label_texts(docs, None).collect()} == {"und"}
    assert lang_id.learned_from(docs.limit(0)) is None


def test_every_character_of_a_long_word_counts(spark):
    parts = {lang: text.replace(" ", "") for lang, text in SENTENCES.items()}
    ends, middle = parts["de"][:24], parts["en"] * 20
    docs = fixture(spark, [(1, ends + middle + ends, "en", "a")])
    assert [r.lang_pred for r in lang_id.label_texts(docs, tiny_model()).collect()] == ["en"]
    labels = [l for _, l, _ in lang_id.word_labels(parts["de"] * 4 + parts["en"] * 4, tiny_model())]
    assert labels[0] == "de" and labels[-1] == "en"
    # Learning parts words as applying does, beyond the first 192 characters too.
    [(_, words)] = lang_id.training_runs(docs.select("text", "lang"))
    assert words == lang_id.pieces(ends + middle + ends) and "".join(words) == ends + middle + ends


def test_held_out_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op3_language(spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert 20 < len(held) < 80 and np.mean(held) > 0.95


def test_rules_of_trees():
    nodes = [
        (0, 0, 1, 4, 1, 0.5),
        (0, 1, 2, 3, 0, 10.0),
        (0, 2, -1, -1, -1, None),
        (0, 3, -1, -1, -1, None),
        (0, 4, -1, -1, -1, None),
        (1, 0, 1, 2, 1, 0.5),
        (1, 1, -1, -1, -1, None),
        (1, 2, -1, -1, -1, None),
        (2, 0, -1, -1, -1, None),
    ]
    rules = quality_model.tree_rules(nodes)
    inf = math.inf
    assert {r.bounds for r in rules} == {
        (("symbols", -inf, 0.5),),
        (("symbols", 0.5, inf),),
        (("symbols", -inf, 0.5), ("words", -inf, 10.0)),
        (("symbols", -inf, 0.5), ("words", 10.0, inf)),
    }


def test_nodes_are_those_of_the_forest(spark):
    rows = spark.range(400).selectExpr(
        "id % 7 + 0.123456789 AS a", "CAST(id % 11 AS double) AS b", "CAST(id % 7 > 3 AND id % 11 < 6 AS double) AS label"
    )
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(vectors)
    nodes = [tuple(n) for n in quality_model.forest_nodes(forest, spark).collect()]
    assert len(nodes) == forest.totalNumNodes
    # Every threshold of the model, once per tree and split.
    stated = re.findall(r"If \(feature (\d+) <= (\S+)\)", forest.toDebugString)
    assert sorted((n[4], n[5]) for n in nodes if n[2] >= 0) == sorted((int(f), float(t)) for f, t in stated)
    names = ("a", "b")
    paths = quality_model.tree_rules(nodes, names)
    assert len(paths) == len(set(paths)) and all(low < high for r in paths for _, low, high in r.bounds)


@pytest.mark.parametrize("labels,lowest,highest", [([], 0.5, 0.5), ([(1, 1), (4, 1)], 0.5, 1.0), ([(1, None)], 0.5, 0.5)])
def test_scores_without_both_labels(spark, labels, lowest, highest):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = fixture(spark)
    rows = quality_model.score_texts(docs, known, ["doc_id"]).collect()
    assert len(rows) == len(TEXTS) and len({r.score for r in rows}) == 1
    assert lowest <= rows[0].score <= highest
    assert quality_model.score_texts(docs.limit(0), known, ["doc_id"]).collect() == []


def test_kept_columns_called_like_inner_ones(spark):
    names = [*quality_model.STATISTICS, "label", "_id", "_keep0", "_text", "features", "score"]
    docs = fixture(spark).select("doc_id", "text", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
    known = spark.createDataFrame([(1, 1), (6, 0), (9, 0), (4, 1)], "doc_id long, quality int")
    got = quality_model.score_texts(docs, known, names)
    assert got.columns == [*names[:-1], "score_", "score"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(r[i] == f"x{i}" for r in rows for i in range(len(names)))


def plain_score(ensemble, row):
    """A fitted ensemble applied rule by rule."""
    total = ensemble.intercept
    for rule, weight in ensemble.weighted:
        total += weight * all(above < row[name] <= upto for name, above, upto in rule.bounds)
    return 1 / (1 + math.exp(-total))


def test_every_score_equals_the_rules_applied_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(fixture(spark).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality_model.statistics(docs, ["doc_id"])
    ensemble = quality_model.fit(rows.join(labels, "doc_id"))
    assert len(ensemble.weighted) > 3
    scored = rows.select("*", ensemble.score().alias("score")).collect()
    assert len(scored) == 200 + len(TEXTS)
    for r in scored:
        assert r.score == pytest.approx(plain_score(ensemble, r.asDict()), abs=1e-9)


def test_every_prediction_equals_the_plain_chain(spark, small):
    """Whole texts of the table, word by word: forward and backward sums in plain Python."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    others = fixture(spark).filter("doc_id < 9 or doc_id = 14").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    docs = table.select("doc_id", "text").unionByName(others)
    model = lang_id.learned_from(table.filter("lang is not null"))
    places = range(len(model.labels))
    rows = lang_id.label_texts(docs.withColumn("id", F.lit(1)), model).join(docs, "doc_id").collect()
    for r in rows:
        words = [lang_id.core(w) for w in lang_id.pieces(r.text or "") if lang_id.has_letter(w)]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        scores, move = model.emissions(words).astype(float), model.transitions.astype(float)
        fore, back = [scores[0]], [np.zeros(len(places))]
        for i in range(1, len(words)):
            fore.append(scores[i] + [np.logaddexp.reduce(fore[-1] + move[:, b]) for b in places])
            back.insert(0, np.array([np.logaddexp.reduce(move[a] + scores[-i] + back[0]) for a in places]))
        shares = np.exp(np.array(fore) + back - np.logaddexp.reduce(fore[-1])).mean(axis=0)
        assert r.score == pytest.approx(shares.max(), abs=2e-3)
        assert shares[model.labels.index(r.lang_pred)] >= shares.max() - 2e-3


def test_statistics_of_small_texts(spark):
    rows = {r.doc_id: r for r in quality_model.statistics(fixture(spark).drop("words"), ["doc_id"]).collect()}
    assert rows[5].words == 0 and rows[5].symbols == 0
    assert rows[13].duplicate_lines == 0.5 and rows[11].symbols > 2
    docs = spark.createDataFrame([(1, "a a a b b c")], "doc_id long, text string")
    one = quality_model.statistics(docs, ["doc_id"]).first()
    assert one.repeats == pytest.approx(3 / 6) and one.distinct_words == pytest.approx(0.5)


def test_held_out_quality(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = queries.op5_quality_model(spark, small)
    assert scored.count() == 200
    rows = scored.join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.85

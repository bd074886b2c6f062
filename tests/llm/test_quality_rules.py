from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import quality_rules as Q
from tests.llm.helpers import TEXTS, fixture, words


def statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def test_statistics_equal_brute_force(spark):
    rows = [*TEXTS, (20, "a b c d e f a b c d e f a b c d e", "en", "a"), (21, "x " * 9 + "x", "en", "a"), (22, "a b c d", "x", "y")]
    got = Q.quality_columns(fixture(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(str((r.doc_id, *[r[n] for n in names])) for r in got) == sorted(str((i, *statistics(t))) for i, t, _, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[1] and verdict[4] and not verdict[9] and not verdict[11] and not verdict[5] and not verdict[12]


def test_order_has_no_influence(spark):
    docs = fixture(spark)
    text = F.coalesce("text", F.lit(""))
    rules = [*Q.base_rules(text), *Q.further_rules(text)]
    one = docs.select("doc_id", Q.first_failed(rules).isNull().alias("ok")).collect()
    other = docs.select("doc_id", Q.first_failed(rules[::-1]).isNull().alias("ok")).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_order_by_rejections_per_second():
    rules = [Q.Rule(n, None) for n in "abcd"]
    measured = [Q.Measured("a", 1.0, 10), Q.Measured("b", 0.1, 10), Q.Measured("c", 0.1, 0), Q.Measured("d", 2.0, 20)]
    assert [r.name for r in Q.ordered(rules, measured)] == ["b", "a", "d", "c"]


def test_filter_and_empty_table(spark):
    docs = fixture(spark)
    kept = Q.drop_rejected(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.quality_columns(docs).collect() if r.kept}
    assert Q.quality_columns(docs.limit(0)).collect() == []


def test_dear_rule_comes_last(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    text = F.col("text")
    burnt = F.aggregate(F.sequence(F.lit(1), F.lit(400)), F.lit(0), lambda s, x: s + F.length(F.sha2(F.concat(text, x.cast("string")), 512)))
    rules = [Q.Rule("dear", burnt > 0), Q.Rule("cheap", F.length(text) > 0), Q.Rule("idle", F.length(text) < 0)]
    report = Q.cascade_report(docs, rules, rows=10_000).orderBy("place").collect()
    assert [r.rule for r in report] == ["cheap", "dear", "idle"]
    assert [(r.rejected, r.sampled, r.selectivity) for r in report] == [(400, 400, 1.0), (400, 400, 1.0), (0, 400, 0.0)]
    assert report[1].seconds > report[0].seconds


def test_sample_follows_the_rows(spark):
    docs = spark.range(0, 20_000, numPartitions=7).selectExpr("id AS doc_id", "'a' AS text")
    assert 1700 < Q.sample_of(docs, "text").count() < 2300
    assert Q.sample_of(docs.limit(0), "text").count() == 0


def test_megabytes_without_white_space(spark):
    long_ = "xy" * 1_500_000
    docs = fixture(spark, [(1, long_, "en", "a"), (2, long_ + "z", "en", "a"), (3, "w " * 400_000, "en", "a")])
    got = {r.doc_id: r for r in Q.quality_columns(docs).collect()}
    for i, text in ((1, long_), (2, long_ + "z")):
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].kept) == (1, len(text), 0, False)
    assert (got[3].n_words, got[3].n_repeat_words, got[3].base_failed) == (400_000, 400_000, True)

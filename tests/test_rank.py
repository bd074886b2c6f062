import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators.digest import digests, ranked_records
from gleanery.operators.rank import band, check_scores, rank_all, rank_for_profiles, top_supplied

AS_OF = dt.datetime(2024, 3, 6, 12)
WORDS = ["red", "blue", "red sox", "sox", "cup", "big cup final", "final", "jo doe", "doe", "x"]


def summaries(spark, rows):
    """(id, title, summary, hours of age)."""
    full = [
        (i, t, f"s{i}", "rss", s, None, AS_OF - dt.timedelta(hours=h), AS_OF) for i, t, s, h in rows
    ]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SUMMARIES.fields)
    return spark.createDataFrame(full, fields)


def profiles(spark, rows):
    return spark.createDataFrame(
        rows, "profile_id string, name string, teams array<string>, players array<string>, interests array<string>"
    )


def score(row, profile):
    _, title, summary, hours = row
    text = f" {title.lower()} {summary.lower()} "
    hits = [len({w for w in (words or []) if f" {w} " in text}) for words in profile[2:]]
    points = 3 * min(hits[0], 2) + 2.5 * min(hits[1], 2) + min(hits[2], 3)
    return round(min(10, points + round(2 * max(0, 1 - hours / 24), 4)), 4)


def best(rows, profile, n):
    order = sorted(rows, key=lambda r: (-score(r, profile), r[3], r[0]))
    return [(profile[0], r[0], k, score(r, profile)) for k, r in enumerate(order[:n], 1)]


@pytest.fixture(scope="module")
def random_case():
    rng = random.Random(7)
    rows = [
        (f"i{n:03}", rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.randint(0, 6))), rng.randint(0, 60) / 2)
        for n in range(150)
    ]
    people = [
        (f"p{n:02}", "N", rng.sample(WORDS, rng.randint(0, 3)), rng.sample(WORDS, rng.randint(0, 2)), rng.sample(WORDS, rng.randint(0, 4)))
        for n in range(40)
    ]
    return rows, [*people, ("none", None, None, None, None), ("same", "N", *people[0][2:])]


@pytest.mark.parametrize("top_n", [1, 5, 40])
def test_top_n_equals_brute_force(spark, random_case, top_n):
    rows, people = random_case
    got = rank_for_profiles(summaries(spark, rows), profiles(spark, people), AS_OF, top_n)
    want = sorted(line for p in people for line in best(rows, p, top_n))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_fewer_items_than_n(spark):
    rows = [("a", "red", "", 1.0), ("b", "x", "", 2.0)]
    got = rank_for_profiles(summaries(spark, rows), profiles(spark, [("p", None, ["red"], [], [])]), AS_OF)
    assert sorted((r["id"], r["rank"]) for r in got.collect()) == [("a", 1), ("b", 2)]
    none = rank_for_profiles(summaries(spark, rows).limit(0), profiles(spark, [("p", None, ["red"], [], [])]), AS_OF)
    assert none.count() == 0


def test_plan_has_no_cross_join(spark, random_case):
    rows, people = random_case
    plan = rank_for_profiles(summaries(spark, rows), profiles(spark, people), AS_OF, 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_rank_all(spark, random_case):
    rows, people = random_case
    profile = {"teams": people[3][2], "players": people[3][3], "interests": people[3][4]}
    got = rank_all(summaries(spark, rows).repartition(7), profile, AS_OF).orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["relevance_score"]) for r in got] == [line[1:] for line in best(rows, people[3], 150)]


def test_supplied_scores(spark):
    rows = [("p", f"s{n}", 5.0, n, "why") for n in range(1, 13)] + [
        ("p", "high", 10.1, 1, "why"),
        ("p", "zero", 5.0, 0, "why"),
        ("p", "nan", float("nan"), 1, "why"),
        ("p", None, 5.0, 1, "why"),
        ("p", "null", None, 1, "why"),
        ("q", "edge", 10.0, 1, "why"),
    ]
    valid, rejects = check_scores(spark.createDataFrame(rows, schemas.SCORES.simpleString()[7:-1].replace(":", " ")))
    assert rejects.count() == 5
    top = top_supplied(valid, 10)
    assert {r["summary_id"] for r in top.collect()} == {f"s{n}" for n in range(1, 11)} | {"edge"}
    # Unknown ids go after the cut, so fewer than ten remain.
    known = summaries(spark, [(f"s{n}", "t", "", 1.0) for n in range(5, 13)])
    items = spark.createDataFrame([("rss", "ss6", "u6")], "source_type string, id string, url string")
    records = ranked_records(top.withColumnRenamed("summary_id", "id"), known, items)
    got = {r["id"]: r["url"] for r in records.collect()}
    assert got == {f"s{n}": "u6" if n == 6 else "" for n in range(5, 11)}
    assert records.columns == schemas.RANKED_COLUMNS


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (9.0, 8.9, 7.0, 5.0, 4.9, 3.0, 0.0)], "v double")
    assert [r[0] for r in df.select(band(F.col("v"))).collect()] == [
        "high", "very relevant", "very relevant", "moderate", "some", "some", "low",
    ]


def test_digest(spark):
    rows = [("p", "a", "A <1>", " one.\n\ntwo & ", "https://x/?a&b", "s", "rss", AS_OF, 1, 9.0, "r"),
            ("p", "b", "B", "three", "", "s", "rss", AS_OF, 2, 8.0, "r")]
    types = "string, {} string, {} string, {} string, {} string, {} string, {} string, {} timestamp_ntz, {} int, {} double, {} string"
    records = spark.createDataFrame(rows, ("{} " + types).format(*schemas.RANKED_COLUMNS))
    people = profiles(spark, [("p", "Ann", [], [], []), ("q", "Bob", [], [], [])])
    (got,) = digests(records, people, AS_OF, "Daily", "Stories").collect()  # no records, no digest
    assert (got["profile_id"], got["run_date"], got["n_items"]) == ("p", dt.date(2024, 3, 6), 2)
    assert got["subject"] == "Daily - March 06, 2024"
    assert got["body_text"].split("\n") == [
        "Daily",
        "",
        "Hi Ann - happy March 06, 2024!",
        "Today's digest has 2 stories. It opens with: A <1>; B.",
        "",
        "Top 2 Stories for March 06, 2024",
        "",
        "1. A <1>",
        "one.",
        "",
        "two &",
        "Read more: https://x/?a&b",
        "",
        "2. B",
        "three",
    ]
    assert "<h3>1. A &lt;1&gt;</h3>\n<p>one.</p>\n<p>two &amp;</p>\n" in got["body_html"]
    assert '<a href="https://x/?a&amp;b">Read more</a>' in got["body_html"]
    assert got["body_html"].count("<hr>") == 2 and got["body_html"].count("Read more") == 1
    unnamed = digests(records, profiles(spark, [("p", None, [], [], [])]), AS_OF).first()
    assert "Hi there - happy" in unnamed["body_text"]


def broadcast_parts(df):
    """What stands below each broadcast in the plan that was chosen before any row was read."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
            yield "\n".join(lines[at:below])


def test_nothing_of_the_size_of_the_profiles_is_broadcast(spark):
    people = spark.range(5_000).select(
        F.concat(F.lit("p"), "id").alias("profile_id"), F.lit("n").alias("name"),
        *[F.array(F.lit("x")).alias(c) for c in ("teams", "players", "interests")],
    )
    made = spark.range(20).select(
        F.concat(F.lit("s"), "id").alias("id"), F.lit("x").alias("title"), F.lit("y").alias("summary_text"),
        F.concat(F.lit("d"), "id").alias("source_id"), F.lit("rss").alias("source_type"),
        F.expr("timestamp_ntz'2024-01-03 00:00:00'").alias("article_created_at"),
    )
    items = made.select("source_type", F.col("source_id").alias("id"), F.lit("u").alias("url"))
    ranked = people.select("profile_id").join(made.select("id")).withColumns({"rank": F.lit(1), "relevance_score": F.lit(2.0)})
    rows = digests(ranked_records(ranked, made, items, people), people, "2024-01-04 00:00:00")
    parts = list(broadcast_parts(rows))
    assert parts and not [p for p in parts if "profile_id" in p]
    assert {(r["n_items"], r["n"]) for r in rows.groupBy("n_items").agg(F.count("*").alias("n")).collect()} == {(20, 5_000)}

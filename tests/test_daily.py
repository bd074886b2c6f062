import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.operators.embed import embed, hashed_terms
from gleanery.operators.summarise import summarise
from gleanery.plans import views
from gleanery.plans.daily import Tables, run_day
from gleanery.sources import store


def counts(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_run_day_twice(spark, small, tmp_path):
    tables = Tables(*(str(tmp_path / name) for name in ("items", "summaries", "digests")))
    batch = views.stored_items(spark, small).drop("created_at").withColumn("batch_pos", F.lit(0).cast("long"))
    profiles = views.profiles(spark, small)
    first = run_day(spark, tables, batch, profiles, views.AS_OF)
    recent = store.read_items(spark, tables.items, views.AS_OF, 24)
    texts = recent.filter("source_type != 'video'").count()  # no video has a transcript here
    assert counts(first["summarised"], "source_type", "items")["video"] == 0
    assert sum(counts(first["summarised"], "source_type", "items").values()) == texts
    steps = counts(first["funnel"], "step", "n_rows")
    assert steps["loaded"] == steps["latest"] == texts >= steps["unclustered"]
    sent = spark.read.parquet(tables.digests)
    assert sent.count() == profiles.count() and sent.filter("n_items != 10").isEmpty()

    again = run_day(spark, tables, batch, profiles, views.AS_OF)
    assert {r["inserted"] for r in again["upserted"].collect()} == {0}
    assert set(counts(again["summarised"], "source_type", "items").values()) == {0}
    assert store.read_summaries(spark, tables.summaries).count() == texts
    assert spark.read.parquet(tables.digests).count() == profiles.count()


def test_models_can_be_supplied(spark, small):
    items = views.items(spark, small)

    def summary(inputs: pd.Series) -> pd.DataFrame:
        assert inputs.str.startswith("Summarise this ").all()
        return pd.DataFrame({"title": inputs.str.len().astype(str), "summary": ["" if len(x) % 2 else "s" for x in inputs]})

    made = summarise(items, views.AS_OF, summary)
    vectors = embed(made, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert len(vectors) == items.count()
    for row in vectors:
        if row["summary_text"] == "":
            assert row["summary_vector"] is None
        else:
            assert row["summary_vector"] == [len(f"Title: {row['title']}\nSummary: s"), 1.0]


def test_models_in_the_daily_run(spark, small, tmp_path):
    tables = Tables(*(str(tmp_path / name) for name in ("items", "summaries", "digests", "rejects")))
    batch = views.stored_items(spark, small).drop("created_at").withColumn("batch_pos", F.lit(0).cast("long"))
    profiles = views.profiles(spark, small).limit(2)
    ids = [r["profile_id"] for r in profiles.collect()]
    source = batch.filter("source_type = 'rss'").orderBy(F.desc("published_date")).first()
    wanted = F.sha2(F.lit(f"rss\u0001{source['id']}"), 256)
    rows = [(ids[0], 9.0, 1), (ids[0], 99.0, 2), (ids[1], 5.0, 0)]
    scores = spark.createDataFrame(rows, "profile_id string, relevance_score double, rank int")
    scores = scores.select("profile_id", wanted.alias("summary_id"), "relevance_score", "rank", F.lit("model").alias("reasoning"))

    def summary(inputs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"title": "T", "summary": "S"}, index=range(len(inputs)))

    done = run_day(
        spark, tables, batch, profiles, views.AS_OF, summary_fn=summary, embed_fn=lambda texts: pd.Series([[1.0, float(i)] for i in range(len(texts))]),
        threshold=1.0, scores=scores, intro=F.concat(F.lit("Read "), F.col("n_items").cast("string")),
    )
    assert done["rejected"].first()[0] == 2 and spark.read.parquet(tables.rejects).count() == 2
    steps = counts(done["funnel"], "step", "n_rows")
    assert list(steps) and steps["ranked"] == 1 and steps["top"] <= 1
    for row in spark.read.parquet(tables.digests).collect():
        assert row["profile_id"] == ids[0] and "Read 1" in row["body_text"] and "1. T\nS" in row["body_text"]


def test_a_missing_summary_ends_the_job(spark, small):
    lost = lambda inputs: pd.DataFrame({"title": "t", "summary": [None] * len(inputs)})
    with pytest.raises(Exception, match="no result for some items"):
        summarise(views.items(spark, small), views.AS_OF, lost).collect()


def test_hashed_terms(spark):
    df = spark.createDataFrame([("a b a",), ("  ",), (None,)], "t string")
    a, blank, none = [r[0] for r in df.select(hashed_terms(F.col("t"), 8)).collect()]
    assert sorted(a)[-2:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and len(a) == 8
    assert blank == [0.0] * 8 and none is None

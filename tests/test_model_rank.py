import json
import re

import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter

from gleanery import schemas
from gleanery.operators import model_rank

AS_OF = "2024-03-06 00:00:00"


def backwards(texts):
    """Scores of a model that turns the list round and says how many texts it was given."""
    lists = [[item["id"] for item in json.loads(text)["items"]][::-1] for text in texts]
    return pd.DataFrame(
        {
            "scores": [
                [dict(summary_id=i, relevance_score=1.0, rank=n + 1, reasoning=text) for n, i in enumerate(ids)]
                for ids, text in zip(lists, texts)
            ]
        }
    )


def tables(spark):
    made = spark.createDataFrame(
        [(f"s{n}", ("red " if n % 2 else "blue ") + str(n), f"text {n}", f"d{n}", "rss", f"2024-03-05 0{n}:00:00") for n in range(8)]
        # One id with two texts, and one summary stored twice.
        + [("s3", "red 3", "other", "d3", "rss", "2024-03-05 03:00:00"), ("s4", "blue 4", "text 4", "d4", "rss", "2024-03-05 04:00:00")],
        "id string, title string, summary_text string, source_id string, source_type string, at string",
    ).selectExpr("id", "title", "summary_text", "source_id", "source_type", "cast(at as timestamp_ntz) as article_created_at")
    rows = [("p", "Ann", ["red"], [], []), ("q", "Bob", ["red"], [], []), ("r", None, ["blue"], [], []),
            ("p2", "Ann", ["red"], [], []), ("twice", "Cy", ["red"], [], []), ("twice", "Di", ["blue"], [], []),
            (None, "No", ["red"], [], [])]
    people = spark.createDataFrame(
        rows, "profile_id string, name string, teams array<string>, players array<string>, interests array<string>"
    )
    return made, people


def ranked(spark, folder):
    made, people = tables(spark)
    rows = model_rank.rank_by_model(made, people, backwards, folder, AS_OF, candidates=3)
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("sent", [32_000_000, 0])
def test_inputs_hold_the_candidates_in_order(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(model_rank, "TEXTS_SENT", sent, raising=False)
    rows = ranked(spark, str(tmp_path / "answers"))
    text = {profile: json.loads(reasoning) for profile, _, _, _, reasoning in rows}
    assert set(text) == {"p", "q", "r", "p2", "twice"}
    assert [i["summary"] for i in text["p"]["items"]] == ["text 7", "text 5", "other", "text 3"]
    assert [i["id"] for i in text["r"]["items"]] == ["s6", "s4", "s4", "s2"]
    # A profile that is there twice asks with its names and with all it may get.
    names = {json.loads(json.loads(r[4])["profile"][0])["name"] for r in rows if r[0] == "twice"}
    assert names == {"Cy", "Di"} and len(text["twice"]["items"]) == 8
    # Profiles that ask the same share one answer.
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 5
    assert rows == ranked(spark, str(tmp_path / "answers"))  # and a rerun asks for nothing
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 5


def test_inputs_are_not_moved(spark, tmp_path, monkeypatch):
    plans = []
    write = DataFrameWriter.parquet

    def seen(self, path, *args, **options):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString() + "\n" + self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    made, people = tables(spark)
    rows = model_rank.rank_by_model(made, people, backwards, str(tmp_path / "answers"), AS_OF, candidates=3)
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    inputs = 0
    for plan in plans:
        physical = plan[plan.find("AdaptiveSparkPlan") :].split("\n")
        at = [n for n, line in enumerate(physical) if re.search(r'concat\(\{"profile":', line)]
        inputs += len(at)
        # Spark prints what comes later above: no shuffle may come after an input is made.
        assert not [line for n in at for line in physical[:n] if "Exchange" in line]
    assert inputs

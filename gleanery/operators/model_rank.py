"""Ranking by a model: each profile with its best candidates, answers kept for reruns.

Profiles go with the numbers of their candidates. Candidates are few beside the profiles that
share them: their records are sent to the profiles, and a model's input is put together where
it is hashed or handed to the model, so that inputs are neither shuffled nor stored. Only where
the records are too many to be sent, they meet the profiles by joins.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.digest import TEXTS_SENT, record_json
from gleanery.operators.rank import rank_for_wishes
from gleanery.operators.remember import answers
from gleanery.schemas import PROFILES
from gleanery.session import freeze_table
from gleanery.sources.profiles import profile_text

# Summaries that a model sees for each profile.
CANDIDATES = 50


def _input(profile: Column, records: Column) -> Column:
    return F.concat(
        F.lit('{"profile":'), F.to_json(F.array(profile)), F.lit(',"items":['), F.array_join(records, ","), F.lit("]}")
    )


def _in_order(place: str) -> Column:
    """What stands at ``place`` in the candidates of a profile, by rank."""
    return F.transform(F.sort_array(F.flatten(F.collect_list("listed"))), lambda r: r[place])


def rank_by_model(
    summaries: DataFrame,
    profiles: DataFrame,
    fn: Callable[[pd.Series], pd.DataFrame],
    results: str,
    as_of=None,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """(profile_id, summary_id, relevance_score, rank, reasoning) as a model ranks them.

    The model gets one text per profile, JSON with ``profile`` and ``items``, the records of the
    ``candidates`` best summaries by the built-in score, and gives a column ``scores``: a list of
    records (summary_id, relevance_score, rank, reasoning). Its answers are kept in the folder
    ``results``, so a rerun asks only for profiles and items that changed. `check_scores` parts
    what is out of range, `top_supplied` cuts to the best.
    """
    of_profile, ranked = rank_for_wishes(summaries, profiles, as_of, candidates)
    ranked = freeze_table(ranked.select("wish", "id", "rank"), "wish-ranks")
    record = record_json(
        id=F.col("id"), title=F.col("title"), source_id=F.col("source_id"), source_type=F.col("source_type"),
        summary=F.col("summary_text"), article_created_at=F.col("article_created_at"),
    )
    wanted = summaries.join(ranked.select("id").distinct(), "id", "left_semi")
    records = freeze_table(wanted.select("id", record.alias("record")), "records")
    told = [c for c in PROFILES.names if c != "profile_id" and c in profiles.columns]
    named = profiles.select("profile_id", profile_text(*told).alias("profile"))
    scores = "scores array<struct<summary_id: string, relevance_score: double, rank: int, reasoning: string>>"

    size = records.agg(F.sum(F.length("record") + 200)).first()[0] or 0
    if size <= TEXTS_SENT:
        # Numbers in the order of the records, all of them in one row: at most `TEXTS_SENT`.
        numbers = freeze_table(
            records.select("record").distinct().withColumn("number", F.row_number().over(Window.orderBy("record")) - 1), "numbers"
        )
        every = numbers.agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "record"))), lambda r: r["record"]).alias("every"))
        every = freeze_table(every, "every")
        numbered = records.join(numbers, "record").select("id", "number")
        place = "number"
    else:
        numbered, place = records, "record"
    of_wish = ranked.join(numbered, "id").groupBy("wish").agg(F.collect_list(F.struct("rank", place)).alias("listed"))
    lists = of_profile.join(of_wish, "wish").groupBy("profile_id").agg(_in_order(place).alias("listed"))
    rows = lists.join(named, "profile_id").select("profile_id", "profile", "listed")

    def made(rows: DataFrame) -> DataFrame:
        items = F.transform("listed", lambda number: F.get("every", number))
        return rows.crossJoin(F.broadcast(every)).withColumn("input", _input(F.col("profile"), items))

    if size <= TEXTS_SENT:
        ranked = answers(freeze_table(rows, "lists"), "input", results, fn, scores, make=made)
    else:
        whole = rows.select("profile_id", _input(F.col("profile"), F.col("listed")).alias("input"))
        ranked = answers(whole, "input", results, fn, scores)
    return ranked.select("profile_id", F.explode("answer.scores").alias("one")).select("profile_id", "one.*")

"""The daily run: the jobs put together over stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.digest import digests, ranked_records
from gleanery.operators.embed import embed
from gleanery.operators.latest import latest_per_source
from gleanery.operators.metrics import Funnel
from gleanery.operators.neardup import THRESHOLD, leading_rows
from gleanery.operators.pending import pending_items, source_counts
from gleanery.operators.rank import TOP_N, check_scores, rank_for_profiles, top_supplied
from gleanery.operators.summarise import summarise
from gleanery.session import as_of_time, cutoff, freeze_table
from gleanery.sources import store


@dataclass(frozen=True)
class Tables:
    """Where the stored tables lie."""

    items: str
    summaries: str
    digests: str
    rejects: str | None = None  # model scores out of range, if they are to be kept
    answers: str | None = None  # what models answered, if reruns are not to ask again


@dataclass(frozen=True)
class Curated:
    kept: DataFrame
    ranked: DataFrame
    records: DataFrame
    counts: Funnel

    def funnel(self) -> DataFrame:
        return self.counts.rows(self.records.sparkSession)


def summarise_pending(
    spark: SparkSession,
    tables: Tables,
    as_of=None,
    hours: float = 24,
    summary_fn: Callable | None = None,
    embed_fn: Callable | None = None,
) -> DataFrame:
    """Summarise and embed the window's open items, store them; returns counts per source."""
    as_of = as_of_time(as_of)
    store.create_table(spark, tables.summaries)
    items = store.read_items(spark, tables.items, as_of, hours)
    known = store.read_summaries(spark, tables.summaries)
    kept = {name: tables.answers and f"{tables.answers}/{name}" for name in ("summaries", "vectors")}
    made = summarise(pending_items(items, known, as_of, hours), as_of, summary_fn, results=kept["summaries"])
    fresh = embed(made, embed_fn, results=kept["vectors"])
    fresh = freeze_table(fresh, "summaries")
    store.append_summaries(fresh, tables.summaries)
    return source_counts(fresh, ["page", "rss", "video"])


def curate(
    summaries: DataFrame,
    items: DataFrame,
    profiles: DataFrame,
    as_of=None,
    hours: float = 24,
    threshold: float = THRESHOLD,
    top_n: int = TOP_N,
    scores: DataFrame | None = None,
) -> Curated:
    """Recent summaries, newest per source, without near duplicates, best per profile.

    ``scores`` are valid scores of a model; they take the place of the built-in ranking,
    and count as ranked before they are cut to ``top_n`` and looked up.
    """
    seen = Funnel()
    recent = seen.watch("loaded", summaries.filter(F.col("article_created_at") >= cutoff(as_of, hours)))
    latest = freeze_table(seen.watch("latest", latest_per_source(recent)), "latest")
    kept = leading_rows(
        latest, "id", [F.desc("created_at"), F.desc("id")], threshold=threshold
    )
    kept = freeze_table(seen.watch("unclustered", kept.drop("summary_vector")), "kept")
    if scores is None:
        ranked = freeze_table(seen.watch("ranked", rank_for_profiles(kept, profiles, as_of, top_n)), "ranked")
        records = ranked_records(ranked, kept, items, profiles)
    else:
        ranked = freeze_table(seen.watch("ranked", scores), "ranked")
        records = ranked_records(top_supplied(ranked, top_n).withColumnRenamed("summary_id", "id"), kept, items)
    records = freeze_table(seen.watch("top", records), "records")
    return Curated(kept, ranked, records, seen)


def run_day(
    spark: SparkSession,
    tables: Tables,
    batch: DataFrame,
    profiles: DataFrame,
    as_of=None,
    hours: float = 24,
    threshold: float = THRESHOLD,
    top_n: int = TOP_N,
    summary_fn: Callable | None = None,
    embed_fn: Callable | None = None,
    scores: DataFrame | None = None,
    intro: Column | None = None,
) -> dict[str, DataFrame]:
    """Store a collected batch, summarise, curate and write the digests; returns the counts.

    Models take the place of the built-in forms: functions for summaries and embeddings, a
    table of scores, a column for the introduction. Scores out of range are counted, and
    stored where ``tables`` names a place.
    """
    as_of = as_of_time(as_of)
    upserted = store.upsert_items(spark, tables.items, batch, as_of)
    summarised = summarise_pending(spark, tables, as_of, hours, summary_fn, embed_fn)
    counts = {"upserted": upserted, "summarised": summarised}
    if scores is not None:
        scores, rejects = check_scores(freeze_table(scores, "scores"))
        counts["rejected"] = rejects.agg(F.count("*").alias("n_rows"))
        if tables.rejects:
            rejects.write.mode("append").parquet(tables.rejects)
    summaries = store.read_summaries(spark, tables.summaries, as_of, hours)
    items = store.read_items(spark, tables.items)
    curated = curate(summaries, items, profiles, as_of, hours, threshold, top_n, scores)
    store.write_digests(digests(curated.records, profiles, as_of, intro=intro), tables.digests)
    return {**counts, "funnel": curated.funnel()}

"""Transcripts put together from their snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(snippets: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Texts of each key joined without a separator, in order of ``position``."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position), F.col("text"))))
    text = F.array_join(F.transform(ordered, lambda s: s["text"]), "")
    return snippets.groupBy(*keys).agg(text.alias("text"))


def transcripts(
    snippets: DataFrame, key: str = "id", position: str = "pos", chunk: int = 256
) -> DataFrame:
    """(``key``, transcript): snippet texts in order, joined by nothing.

    Runs of ``chunk`` positions are joined first, so the snippets of one very
    long recording are spread over tasks and only its pieces meet at the end.
    """
    run = F.floor(F.col(position) / chunk).alias("run")
    rows = snippets.select(key, F.col(position).alias("at"), run, F.coalesce("text", F.lit("")).alias("text"))
    pieces = _joined(rows, [key, "run"], "at")
    return _joined(pieces, [key], "run").withColumnRenamed("text", "transcript")


def with_transcripts(videos: DataFrame, snippets: DataFrame) -> DataFrame:
    """Videos with their transcript, null when there is none."""
    wanted = snippets.join(videos.select("id"), "id", "left_semi")
    return videos.join(transcripts(wanted), "id", "left")

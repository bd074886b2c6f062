"""Row counts of the steps of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Funnel:
    """Counts the rows of steps while the jobs that compute them run; no step is computed for it."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, step: str, rows: DataFrame) -> DataFrame:
        """``rows``, counted as ``step`` by the first job that reads them to their end."""
        self._seen[step] = Observation()
        return rows.observe(self._seen[step], F.count(F.lit(1)).alias("n_rows"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step, position, n_rows) in the order the steps were named; waits for jobs not yet run."""
        counted = [(step, at, seen.get["n_rows"]) for at, (step, seen) in enumerate(self._seen.items(), 1)]
        return spark.createDataFrame(counted, "step string, position int, n_rows long")

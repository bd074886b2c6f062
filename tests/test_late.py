from datetime import datetime, timedelta

from gleanery.streaming import ingest

SCHEMA = "k string, at timestamp_ntz, v int"
NOON = datetime(2024, 1, 3, 12)


def hours(n):
    return NOON + timedelta(hours=n)


STEPS = [
    [("a", hours(0), 1), ("a", hours(-1), 2), ("b", hours(-30), 3), (None, hours(0), 4), ("n", None, 5)],
    [("a", hours(2), 6), ("c", hours(-25), 7), ("d", hours(-24), 8), (None, hours(1), 9), ("n", None, 10), ("b", hours(30), 11)],
    [("a", hours(29), 12), ("d", hours(5), 13), ("e", hours(31), 14), ("e", hours(31), 14)],
    [],
    [("f", hours(6), 15), ("g", hours(7), 16)],
]


def test_late_rows_are_kept_apart(spark, tmp_path):
    landing, out, late, progress = (str(tmp_path / n) for n in ("landing", "out", "late", "progress"))
    for step in STEPS:
        spark.createDataFrame(step, SCHEMA).write.mode("append").parquet(landing)
        stream = ingest.landed_stream(spark, landing, spark.createDataFrame([], SCHEMA).schema)
        ingest.first_seen_stream(stream, ["k"], "at", out, late, progress).awaitTermination()
    kept = sorted(r.v for r in spark.read.parquet(out).collect())
    behind = sorted(r.v for r in spark.read.parquet(late).collect())
    # b at -30 comes with the first batch, before which nothing is late; d at -24 is on the bound.
    # In the third batch the bound is 6 hours after noon: "a" of noon is forgotten.
    assert kept == [2, 3, 4, 5, 8, 11, 12, 14, 16]
    assert behind == [7, 13, 15]

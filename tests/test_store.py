import datetime as dt
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators.pending import pending_items, source_counts
from gleanery.plans import queries
from gleanery.sources import store
from gleanery.streaming import ingest

SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ITEM_BATCH.fields) + ", batch_pos long"


def batch(spark, *rows):
    """Rows (source, id, title, day of March)."""
    full = [
        (s, i, t, "", f"u/{i}", dt.datetime(2024, 3, d, 12), "text", None, n) for n, (s, i, t, d) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def titles(spark, path, *args):
    return {(r["source_type"], r["id"]): (r["title"], r["created_at"].day) for r in store.read_items(spark, path, *args).collect()}


def days(path):
    return {name.partition("=")[2] for name in os.listdir(f"{path}/items") if name.startswith("published_day=")}


def counts(df):
    return {r["source_type"]: (r["inserted"], r["updated"]) for r in df.collect()}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "items")
    first = batch(spark, ("rss", "a", "a1", 1), ("rss", "a", "a2", 1), ("page", "a", "p", 2), ("rss", "b", "b", 2))
    # The second copy of a new id counts as updated.
    assert counts(store.upsert_items(spark, path, first, "2024-03-03")) == {"rss": (2, 1), "page": (1, 0)}
    assert titles(spark, path) == {("rss", "a"): ("a2", 3), ("rss", "b"): ("b", 3), ("page", "a"): ("p", 3)}

    second = batch(spark, ("rss", "b", "b2", 2), ("rss", "c", "c", 4))
    for expected in ((1, 1), (0, 2)):  # applied twice, the table is the same
        assert counts(store.upsert_items(spark, path, second, "2024-03-05")) == {"rss": expected}
        assert titles(spark, path) == {
            ("rss", "a"): ("a2", 3), ("rss", "b"): ("b2", 3), ("page", "a"): ("p", 3), ("rss", "c"): ("c", 5),
        }
    assert counts(store.upsert_items(spark, path, batch(spark, ("rss", "x", "x", 1)).limit(0), "2024-03-05")) == {}


def test_a_changed_date_moves_the_row(spark, tmp_path):
    path = str(tmp_path / "items")
    store.upsert_items(spark, path, batch(spark, ("rss", "a", "a", 1), ("rss", "b", "b", 2)), "2024-03-02")
    store.upsert_items(spark, path, batch(spark, ("rss", "a", "a2", 4)), "2024-03-04")
    assert titles(spark, path) == {("rss", "a"): ("a2", 2), ("rss", "b"): ("b", 2)}
    assert days(path) == {"2024-03-02", "2024-03-04"}  # the emptied day is gone


@pytest.mark.parametrize("step", ["merge_items", "_replace_days"])
def test_a_run_that_dies_before_its_commit_changes_no_item(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "items")
    store.upsert_items(spark, path, batch(spark, ("rss", "a", "a", 1), ("rss", "b", "b", 1)), "2024-03-02")
    before = titles(spark, path)
    more = batch(spark, ("rss", "a", "a2", 4), ("rss", "c", "c", 1))

    def dies(*_):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(store, step, dies)
        with pytest.raises(OSError):
            store.upsert_items(spark, path, more, "2024-03-04")
    assert titles(spark, path) == before
    assert counts(store.upsert_items(spark, path, more, "2024-03-04")) == {"rss": (1, 1)}
    assert titles(spark, path) == {("rss", "a"): ("a2", 2), ("rss", "b"): ("b", 2), ("rss", "c"): ("c", 4)}


def test_a_run_that_dies_within_its_commit_is_mended_by_the_next(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "items")
    store.upsert_items(spark, path, batch(spark, ("rss", "a", "a", 1), ("rss", "b", "b", 2)), "2024-03-02")
    more = batch(spark, ("rss", "a", "a2", 4))
    replace = store._replace_days
    with monkeypatch.context() as patch:
        # The new day is there, the old one has not been dropped.
        patch.setattr(store, "_replace_days", lambda spark, merged, where, touched: replace(spark, merged, where, set()))
        store.upsert_items(spark, path, more, "2024-03-04")
    assert store.read_items(spark, path).count() == 3
    store.upsert_items(spark, path, more, "2024-03-05")
    assert titles(spark, path) == {("rss", "a"): ("a2", 2), ("rss", "b"): ("b", 2)}
    assert store.read_items(spark, path).count() == 2


def test_lookback_prunes_days(spark, tmp_path):
    path = str(tmp_path / "items")
    store.upsert_items(spark, path, batch(spark, *[("rss", str(d), "t", d) for d in range(1, 9)]), "2024-03-08")
    recent = store.read_items(spark, path, "2024-03-08 12:00:00", 24)
    assert {r["id"] for r in recent.collect()} == {"7", "8"}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_day" in plan and "2024-03-07" in plan


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_keys_are_looked_up_where_they_lie(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(store, "HASHES_SENT", sent)
    path = str(tmp_path / "items")
    store.upsert_items(spark, path, batch(spark, *[("rss", str(n), "t", n % 28 + 1) for n in range(300)]), "2024-03-08")
    asked = batch(spark, ("rss", "7", "x", 3), ("rss", "new", "x", 3), ("page", "7", "x", 3))
    found = store.stored_days(spark, path, asked)
    assert [tuple(r) for r in found.collect()] == [("rss", "7", dt.date(2024, 3, 8))]
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(at for at, line in enumerate(lines) if "FileScan" in line and "key_hash" in line)
    if sent:
        # What stands over the scan first is the filter by hashes, not a shuffle.
        above = next(line for line in reversed(lines[:scan]) if "Join" in line or "Exchange hashpartitioning" in line)
        assert "BroadcastHashJoin [key_hash" in above and "LeftSemi" in above


def test_merge_into_is_left_to_the_table_format(spark, tmp_path):
    # The formats at hand here have no row-level operations; Spark says so.
    spark.sql("drop table if exists plain_items")
    spark.sql(f"create table plain_items ({store._schema(schemas.ITEMS.fields)}) using parquet location '{tmp_path / 'plain'}'")
    with pytest.raises(Exception, match="MERGE"):
        store.upsert_into(batch(spark, ("rss", "a", "a", 1)), "plain_items", "2024-03-05")
    spark.sql("drop table plain_items")


def test_missing_table_is_empty(spark, tmp_path):
    store.create_table(spark, str(tmp_path / "none"))
    assert store.read_items(spark, str(tmp_path / "none")).count() == 0
    assert store.read_summaries(spark, str(tmp_path / "none")).count() == 0


def test_pending(spark):
    rows = [
        ("rss", "a", "2024-03-05 12:00:00", None),
        ("rss", "edge", "2024-03-04 12:00:00", None),
        ("rss", "old", "2024-03-04 11:59:59", None),
        ("rss", "done", "2024-03-05 12:00:00", None),
        ("page", "done", "2024-03-09 12:00:00", None),
        ("video", "mute", "2024-03-05 12:00:00", None),
        ("video", "empty", "2024-03-05 12:00:00", ""),
    ]
    items = spark.createDataFrame(rows, "source_type string, id string, d string, transcript string")
    items = items.withColumn("published_date", F.col("d").cast("timestamp_ntz"))
    done = spark.createDataFrame([("rss", "done"), ("rss", "done")], "source_type string, source_id string")
    got = pending_items(items, done, "2024-03-05 12:00:00", 24)
    assert {(r["source_type"], r["id"]) for r in got.collect()} == {
        ("rss", "a"), ("rss", "edge"), ("page", "done"), ("video", "empty"),
    }
    assert {r[0]: r[1] for r in source_counts(got, ["rss", "page", "video", "none"]).collect()} == {
        "rss": 2, "page": 1, "video": 1, "none": 0,
    }


def test_texts_of_stored_items_stay_where_they_are(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "items")
    store.upsert_items(spark, path, batch(spark, *[("rss", str(n), "t", n % 3 + 1) for n in range(300)]), "2024-03-08")
    plans = []
    write = DataFrameWriter.parquet

    def seen(self, where, *args, **options):
        if "content" in self._df.columns:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return write(self, where, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    again = batch(spark, ("rss", "7", "x", 3), ("rss", "new", "x", 2), ("rss", "7", "y", 1))
    assert counts(store.upsert_items(spark, path, again, "2024-03-09")) == {"rss": (1, 2)}
    # Texts are written twice: the batch, and the days.
    assert len(plans) == 2
    scan = next(n for n, line in enumerate(plans[1]) if "FileScan" in line and "content#" in line and "published_day" in line)
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in plans[1]]
    above, low = [], depth[scan]
    for n in range(scan - 1, -1, -1):  # from the scan to the root
        if depth[n] < low:
            above, low = [*above, plans[1][n]], depth[n]
    assert above and not [line for line in above if "Exchange" in line]
    assert titles(spark, path)[("rss", "7")] == ("y", 8) and len(titles(spark, path)) == 301


@pytest.mark.parametrize("sent", [200_000, 0])
def test_copies_and_missing_keys(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(store, "ROWS_SENT", sent, raising=False)
    path = str(tmp_path / "items")
    first = batch(spark, ("rss", "a", "a1", 1), ("rss", None, "n1", 1), ("rss", "a", "a2", 2), ("rss", None, "n2", 2), ("rss", "b", "b", 1))
    # A missing key is no key that an item could be found by: it counts as new each time.
    assert counts(store.upsert_items(spark, path, first, "2024-03-03")) == {"rss": (3, 2)}
    more = batch(spark, ("rss", "a", "a3", 1), ("rss", "a", "a4", 3), ("rss", None, "n3", 2), ("rss", "c", "c", 1))
    for _ in range(2):
        store.upsert_items(spark, path, more, "2024-03-05")
        got = sorted((str(r.id), r.title, r.published_date.day, r.created_at.day) for r in store.read_items(spark, path).collect())
        assert got == [("None", "n2", 2, 3), ("None", "n3", 2, 5), ("a", "a4", 3, 3), ("b", "b", 1, 3), ("c", "c", 1, 5)]


def test_a_stream_writes_texts_twice(spark, tmp_path, monkeypatch):
    landing, path, progress = (str(tmp_path / name) for name in ("landing", "items", "progress"))
    written = []
    write = DataFrameWriter.parquet

    def seen(self, where, *args, **options):
        if "content" in self._df.columns:
            written.append(where)
        return write(self, where, *args, **options)

    for rows in ([("rss", "a", "a", 1), ("rss", "b", "b", 2)], [("rss", "a", "a2", 3)]):
        batch(spark, *rows).write.mode("append").parquet(landing)
        with monkeypatch.context() as patch:
            patch.setattr(DataFrameWriter, "parquet", seen)
            stream = ingest.landed_stream(spark, landing, batch(spark, *rows).schema)
            ingest.upsert_stream(stream, path, progress, "2024-03-05").awaitTermination()
        # The batch, and its days.
        assert len(written) == 2 and written[1] == f"{path}/items"
        written.clear()
    assert titles(spark, path) == {("rss", "a"): ("a2", 5), ("rss", "b"): ("b", 5)}


@pytest.mark.parametrize("least", [1, 1 << 40])
def test_a_batch_of_large_files_is_written_to_its_days_from_where_it_lies(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(store, "FILE_BYTES", least, raising=False)
    path, plans = str(tmp_path / "items"), []
    write = DataFrameWriter.parquet

    def seen(self, where, *args, **options):
        if where == f"{path}/items":
            plans.append(self._df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return write(self, where, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    first = [("rss", str(n), "t", n % 3 + 1) for n in range(300)]
    store.upsert_items(spark, path, batch(spark, *first, ("rss", "7", "u", 4)), "2024-03-08")
    more = batch(spark, ("rss", "7", "x", 3), ("rss", "new", "x", 2), ("rss", "7", "y", 1))
    assert counts(store.upsert_items(spark, path, more, "2024-03-09")) == {"rss": (1, 2)}
    got = titles(spark, path)
    assert len(got) == store.read_items(spark, path).count() == 301
    assert got[("rss", "7")] == ("y", 8) and got[("rss", "new")] == ("x", 9) and got[("rss", "8")] == ("t", 8)
    assert days(path) == {"2024-03-01", "2024-03-02", "2024-03-03"}
    moved = [line for plan in plans for line in plan if "Exchange" in line and "REBALANCE" in line]
    assert len(plans) == 2 and bool(moved) == (least > 1)


def test_a_landed_batch_is_packed(spark, tmp_path, monkeypatch):
    landed = []
    write = DataFrameWriter.parquet

    def seen(self, where, *args, **options):
        write(self, where, *args, **options)
        if "/landing" in where:
            landed.extend(name for name in os.listdir(where) if name.startswith("part-"))

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    for name, rows in {
        "documents": spark.createDataFrame([(n, f"text {n}", "en", "a") for n in range(5)], "doc_id long, text string, lang string, source string"),
        "benchmark": spark.createDataFrame([(4, "new")], "item_id long, text string"),
    }.items():
        write(rows.write, str(tmp_path / f"{name}.parquet"))
    got = {(r["id"], r["title"], r["content"]) for r in queries.stream_upsert(spark, str(tmp_path)).collect()}
    assert got == {*((f"d{n}", f"text {n}", f"text {n}") for n in range(4)), ("d4", "version 1", "new"), ("b4", "version 1", "new")}
    assert landed and all(name.endswith(".zstd.parquet") for name in landed)

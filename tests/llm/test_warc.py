import gzip
import hashlib
import io

from pyspark.sql import functions as F

from gleanery.llm import warc
from gleanery.session import scratch_path

PAGES = [
    (1, "http://a.example/ one", "x" * 2000),
    (2, None, "x" * 2000),
    (3, "http://a.example/é\r\nX: y", "x" * 2000),
    (None, "http://b.example/", "x" * 2000),
    (4, "http://c.example/", None),
    (5, "http://c.example/", ""),
    (6, "http://c.example/", "short"),
    (7, "http://c.example/", "short"),
    (7, "http://d.example/", "é" * 600),
    (7, "http://d.example/", "é" * 600),
    (8, "http://d.example/", "\r\n\r\nWARC/1.1\r\n" * 300),
]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.withColumn("payload", F.lit("clash")).withColumn("_key", F.lit(1))


def test_records_and_revisits(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_pages(pages(spark), folder)
    rows = warc.read_archives(spark, folder).collect()
    assert len(rows) == len(PAGES)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.record_id, []).append(r)
    for i in (1, 2):
        assert by_id[f"urn:gleanery:page:{i}"][0].record_type == "revisit"
        assert by_id[f"urn:gleanery:page:{i}"][0].refers_to == "urn:gleanery:page:3"
    assert [r.record_type for r in by_id["urn:gleanery:page:7"]] == ["response"] * 3  # repeated largest id
    assert by_id["urn:gleanery:page:6"][0].record_type == "response"
    want = sorted((len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for _, _, h in PAGES)
    assert sorted((r.payload_bytes, r.payload_digest) for r in rows) == want
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None


def test_push_down_and_payload_option(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_pages(pages(spark), folder)
    everything = warc.read_archives(spark, folder, payload=False)
    assert everything.filter(F.col("payload").isNotNull()).count() == 0
    for condition, n in (
        (F.col("record_type") == "revisit", 3),
        (F.col("record_type").isin("response"), 8),
        (F.col("record_type").isin("x", "y"), 0),
        (F.col("target_uri").startswith("http://c."), 4),
        (F.col("refers_to").isNull() & (F.col("payload_bytes") > 1000), 4),
        (F.col("record_id") == "urn:gleanery:page:8", 1),
    ):
        assert everything.filter(condition).count() == n
    reader = warc.WarcReader({"path": folder})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and len(reader.filters) == 1


def test_unwanted_payloads_are_not_inflated():
    row = dict(payload=b"p" * 5_000_000, record_type="response", payload_bytes=5_000_000, record_id="urn:x:1",
               payload_digest="00" * 20, target_uri="http://a/", refers_to=None)
    data = warc.member(warc.record(row)) * 2
    inflated = []

    class Counting(warc._Member):
        def end(self, size):
            inflated.append(len(self.data))
            return super().end(size)

    original, warc._Member = warc._Member, Counting
    try:
        assert list(warc.read_records(io.BytesIO(data), len(data), lambda f: False, True)) == []
        assert len(list(warc.read_records(io.BytesIO(data), len(data), lambda f: True, False))) == 2
    finally:
        warc._Member = original
    assert max(inflated) <= warc.HEADER_BYTES


def test_archives_from_elsewhere(spark, tmp_path):
    row = dict(payload=b"hello", record_type="response", payload_bytes=5, record_id="urn:x:1",
               payload_digest=hashlib.sha1(b"hello").hexdigest(), target_uri="http://a/", refers_to=None)
    plain = warc.record(row)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + plain + plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(plain))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == [("response", b"hello")] * 3 + [("warcinfo", b"a: b")] * 2


def test_archives_roll_and_stray_files_are_not_read(spark):
    folder = scratch_path(spark, "warc-test")
    warc.register(spark)
    plan = warc.plan_revisits(pages(spark)).coalesce(1)
    plan.write.format(warc.FORMAT).option("archive_bytes", 200).mode("append").save(folder)
    store, root = warc.opened(folder)
    with store.open_output_stream(f"{root}/pages-lost.warc.gz", compression=None) as out:
        out.write(b"half")
    assert len(warc.WarcReader({"path": folder, "split_bytes": "300"}).partitions()) > 3
    assert warc.read_archives(spark, folder).count() == len(PAGES)


def test_appends_add_up_and_overwrite_replaces(spark):
    folder = scratch_path(spark, "warc-test")
    rows = [(i, f"http://a.example/{i}", f"page {i}") for i in range(10)]
    warc.write_pages(pages(spark, rows[:5]), folder)
    warc.write_pages(pages(spark, rows[5:]), folder)
    warc.write_pages(pages(spark, rows).limit(0), folder)
    found = warc.read_archives(spark, folder).select("record_id").collect()
    assert sorted(r.record_id for r in found) == [f"urn:gleanery:page:{i}" for i in range(10)]
    warc.plan_revisits(pages(spark, rows[:2])).write.format(warc.FORMAT).mode("overwrite").save(folder)
    assert warc.read_archives(spark, folder).count() == 2
    store, root = warc.opened(folder)
    left = store.get_file_info(warc.pafs.FileSelector(root))
    assert sum(i.base_name.startswith(warc.MANIFEST) for i in left) == 1


def test_failed_write_leaves_the_folder_as_it_was(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_pages(pages(spark), folder)
    writer = warc.WarcWriter({"path": folder})
    store, root = warc.opened(folder)
    with store.open_output_stream(f"{root}/pages-x.warc.gz", compression=None) as out:
        out.write(b"half")
    with store.open_output_stream(f"{root}/{warc.MANIFEST}-x.part") as out:
        out.write(b"[[")
    writer.abort([warc.Written([("pages-x.warc.gz", 4, 1)]), None])
    assert warc.read_archives(spark, folder).count() == len(PAGES)


def test_empty_table(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_pages(pages(spark).limit(0), folder)
    assert warc.read_archives(spark, folder).collect() == []

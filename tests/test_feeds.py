import datetime as dt

from pyspark.sql import functions as F

from gleanery.sources.feeds import atom_items, rss_items, source_list
from gleanery.sources.profiles import NO_PROFILE, profile_text, read_profiles
from gleanery.sources.transcripts import transcripts, with_transcripts

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><guid isPermaLink="false">a</guid><title>A &amp; B</title><description><![CDATA[<p>d</p>]]></description>
<link>https://s.com/a</link><pubDate>Tue, 5 Mar 2024 10:00:00 EST</pubDate></item>
<item><guid>edge</guid><title>E</title><description>e</description><link>https://s.com/e</link>
<pubDate>Tue, 5 Mar 2024 12:00:00 +0000</pubDate></item>
<item><guid>in</guid><title>I</title><link>https://s.com/i</link><pubDate>Tue, 5 Mar 2024 12:00:01 GMT</pubDate></item>
<item><guid>undated</guid><title>U</title><link>https://s.com/u</link></item>
</channel></rss>"""

ATOM = """<?xml version="1.0"?><feed xmlns:yt="urn:y" xmlns:media="urn:m" xmlns="http://www.w3.org/2005/Atom">
<title>channel</title>
<entry><yt:videoId>v1</yt:videoId><title>V</title><link rel="alternate" href="https://v.com/watch?v=v1"/>
<published>2024-03-05T20:00:00+00:00</published><media:group><media:title>V</media:title>
<media:description>about</media:description></media:group></entry>
<entry><yt:videoId>v2</yt:videoId><title>S</title><link href="https://v.com/shorts/v2"/>
<published>2024-03-05T20:00:00+00:00</published></entry></feed>"""

AS_OF = "2024-03-06 12:00:00"


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text("<rss><channel></channel></rss>")
    got = {r["id"]: r for r in rss_items(spark, str(tmp_path), AS_OF).collect()}
    assert set(got) == {"a", "in"}  # the window is open at its start
    assert got["a"]["published_date"] == dt.datetime(2024, 3, 5, 15)
    assert (got["a"]["title"], got["a"]["description"]) == ("A & B", "<p>d</p>")
    assert got["in"]["description"] == ""


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    (tmp_path / "empty.xml").write_text("<feed></feed>")
    got = atom_items(spark, [str(tmp_path / "a.xml"), str(tmp_path / "empty.xml")], AS_OF).collect()
    assert [(r["id"], r["url"], r["description"], r["source_type"]) for r in got] == [
        ("v1", "https://v.com/watch?v=v1", "about", "video")
    ]


def test_source_list(spark):
    rows = [("video", "https://v.com/channel/UC1"), ("rss", "https://s.com/rss")]
    got = {r["source_type"]: r["landed_from"] for r in source_list(spark, rows, "https://v.com/f?id=").collect()}
    assert got == {"video": "https://v.com/f?id=UC1", "rss": "https://s.com/rss"}


def test_transcripts(spark):
    rows = [("a", n, f"{n},") for n in range(1000)] + [("b", 1, None), ("b", 0, "x")]
    snippets = spark.createDataFrame(rows, "id string, pos long, text string").orderBy(F.rand(3))
    got = {r["id"]: r["transcript"] for r in transcripts(snippets, chunk=7).collect()}
    assert got == {"a": "".join(f"{n}," for n in range(1000)), "b": "x"}
    videos = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {r["id"]: r["transcript"] for r in with_transcripts(videos, snippets).collect()} == {"b": "x", "c": None}


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"profile_id":"p1","name":"Ann","teams":["Reds"],"preferences":{"short":true}}\n{"profile_id":"p2"}\n'
    )
    got = read_profiles(spark, str(tmp_path / "p.json")).withColumn("text", profile_text())
    texts = {r["profile_id"]: r["text"] for r in got.collect()}
    assert texts == {"p1": '{"name":"Ann","teams":["Reds"],"preferences":{"short":true}}', "p2": NO_PROFILE}

import datetime as dt
import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from gleanery.functions.html import PageRules
from gleanery.operators import collect, remember
from gleanery.operators.articles import page_articles, with_page_content
from gleanery.operators.embed import embed
from gleanery.operators.summarise import summarise
from gleanery.plans import views
from gleanery.schemas import ITEM_BATCH
from gleanery.sources import store
from gleanery.streaming import ingest

SITE = collect.Site("https://www.example.com", "example")


def page(title, body, when="2024-03-05T10:00:00Z"):
    return f'<h1>{title}</h1><meta name="date" content="{when}"><article><p>{body}</p></article>'


def test_frontier_skips_known_addresses(spark):
    links = spark.createDataFrame([("l", 0, "u/a"), ("l", 1, "u/b"), ("m", 0, "u/a")], "page_url string, pos int, url string")
    known = spark.createDataFrame([("u/b",), ("u/b",)], "url string")
    assert [r.url for r in collect.frontier(links, known).collect()] == ["u/a"]
    assert {r.url for r in collect.frontier(links).collect()} == {"u/a", "u/b"}


def test_collection_end_to_end(spark, tmp_path):
    listing = '<a href="/news/one">1</a><a href="/news/two?x">2</a><a href="/news/gone">3</a><a href="/news/two">2</a><a href="/news/old">4</a>'
    listings = spark.createDataFrame([("https://www.example.com/news", listing), ("https://www.example.com/more", None)], "url string, html string")
    landed = [
        ("https://www.example.com/news/one", page("One", "First.")),
        ("https://www.example.com/news/two/", page("Two", "Second.")),
        ("https://www.example.com/news/gone", None),  # could not be fetched
        ("https://www.example.com/news/old", page("Old", "Known.")),
        ("https://www.example.com/news/unlisted", page("No", "None.")),
        ("https://feeds.example.com/f1", '<div class="article-body">Content: short</div>'),
        ("https://feeds.example.com/f1", '<div class="article-body">Content: a longer one</div>'),
        ("https://feeds.example.com/f2", None),
    ]
    pages = spark.createDataFrame(landed, "url string, html string")
    known = spark.createDataFrame([("https://www.example.com/news/old",), ("no address",)], "url string")
    articles = collect.site_articles(listings, pages, SITE, "2024-03-06", 48, collect.known_urls(known, SITE))
    assert sorted(r.id for r in articles.collect()) == ["one", "two"]

    at = dt.datetime(2024, 3, 5, 9)
    fields = "source_type string, id string, title string, description string, url string, published_date timestamp_ntz"
    feed = spark.createDataFrame(
        [
            ("rss", "f1", "F1", "", "https://feeds.example.com/f1", at),
            ("rss", "f2", "F2", "", "https://feeds.example.com/f2", at),
            ("rss", "f2", "F2 later", "", "https://feeds.example.com/f2", at + dt.timedelta(hours=1)),
            ("rss", None, "no id", "", "https://feeds.example.com/f3", at),
            ("rss", "f4", None, "", "https://feeds.example.com/f4", at),
        ],
        fields,
    )
    clips = spark.createDataFrame([("video", "v1", "V1", "", "v/1", at), ("video", "v2", "V2", "", "v/2", at)], fields)
    snippets = spark.createDataFrame([("v1", 1, "b"), ("v1", 0, "a")], "id string, pos int, text string")
    batch, counts = collect.collect_batch(feed, clips, snippets, pages, articles)
    assert {r.source_type: r["items"] for r in counts.collect()} == {"rss": 3, "video": 2, "page": 2}
    assert batch.columns == [*ITEM_BATCH.names, "batch_pos"]

    path = str(tmp_path / "items")
    done = {r.source_type: (r.inserted, r.updated) for r in store.upsert_items(spark, path, batch, "2024-03-06").collect()}
    assert done == {"rss": (2, 1), "video": (2, 0), "page": (2, 0)}
    items = {r.id: r for r in store.read_items(spark, path).collect()}
    assert (items["f1"].content, items["f2"].title, items["v1"].transcript, items["v2"].transcript) == ("a longer one", "F2 later", "ab", None)


def test_an_empty_collection(spark):
    none = spark.createDataFrame([], "source_type string, id string, title string, description string, url string, published_date timestamp_ntz")
    pages = spark.createDataFrame([], "url string, html string")
    snippets = spark.createDataFrame([], "id string, pos int, text string")
    articles = collect.site_articles(pages, pages, SITE, "2024-03-06")
    batch, counts = collect.collect_batch(none, none, snippets, pages, articles)
    assert batch.collect() == [] and {r["items"] for r in counts.collect()} == {0}


def test_missing_and_repeated_pages(spark):
    pages = spark.createDataFrame([("https://www.example.com/news/a", None), ("https://www.example.com/news/b", page("B", "b"))], "url string, html string")
    assert [r.id for r in page_articles(pages, "https://www.example.com", "example", hours=None).collect()] == ["b"]
    entries = pages.select(F.col("url").alias("id"), "url")
    twice = pages.unionByName(pages)
    assert with_page_content(entries, twice, PageRules()).count() == 2


def calls(folder):
    return sum(int((folder / name).read_text()) for name in os.listdir(folder))


def test_models_are_asked_once_per_input(spark, small, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    folder = str(asked)

    def summary(texts: pd.Series) -> pd.DataFrame:
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(str(len(texts)))
        return pd.DataFrame({"title": texts.str[:20], "summary": texts.str[-30:]}, index=texts.index)

    items = views.items(spark, small).limit(60).cache()
    inputs = items.select("source_type", "title", "content", "description").distinct().count()
    results = str(tmp_path / "results")
    first = summarise(items, views.AS_OF, summary, results=results).collect()
    assert len(first) == items.count() and calls(asked) == inputs
    again = summarise(items, views.AS_OF, summary, results=results).collect()
    assert sorted(first) == sorted(again) and calls(asked) == inputs
    more = summarise(items.unionByName(items.limit(1).withColumn("title", F.lit("new"))), views.AS_OF, summary, results=results)
    assert len(more.collect()) == len(first) + 1 and calls(asked) == inputs + 1

    def vectors(texts):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(str(len(texts)))
        return [[float(len(t)), 1.0] for t in texts]

    made = summarise(items, views.AS_OF)
    before = calls(asked)
    for _ in range(2):
        rows = embed(made, vectors, results=str(tmp_path / "vectors")).collect()
        assert all((r.summary_vector is None) == (r.summary_text == "") for r in rows)
    asked_for = {(r.title, r.summary_text) for r in rows if r.summary_text}
    assert calls(asked) == before + len(asked_for)


def test_rows_without_input_have_no_answer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, t string")
    told = remember.answers(rows, "t", str(tmp_path / "r"), lambda t: t.str.upper().to_frame("up"), "up string")
    assert {r.id: r.answer and r.answer.up for r in told.collect()} == {1: "A", 2: None, 3: "A"}


def test_feeds_as_a_stream(spark, tmp_path):
    landing, path, rejects = (str(tmp_path / name) for name in ("landing", "items", "rejects"))
    os.makedirs(landing)

    def item(i, title="t", when="Tue, 05 Mar 2024 10:00:00 GMT"):
        return f"<item><guid>{i}</guid><title>{title}</title><link>u/{i}</link><pubDate>{when}</pubDate></item>"

    def run():
        stream = ingest.rss_stream(spark, landing)
        ingest.feed_stream(stream, path, rejects, str(tmp_path / "progress"), "2024-03-06").awaitTermination()
        return {r.id: r.title for r in store.read_items(spark, path).collect()}

    def land(name, *items):
        with open(f"{landing}/{name}.xml", "w") as file:
            file.write("<rss><channel>" + "".join(items) + "</channel></rss>")

    land("one", item("a"), item("b"), item("d", when="some day"), item("old", when="Fri, 01 Mar 2024 10:00:00 GMT"), "<item><guid>c</guid><title>broken</item>", item("after"))
    assert run() == {"a": "t", "b": "t"}
    land("two", item("b", "later", "Tue, 05 Mar 2024 11:00:00 GMT"), item("b"), item("e"))
    land("empty")
    assert run() == {"a": "t", "b": "later", "e": "t"}
    assert run() == {"a": "t", "b": "later", "e": "t"}  # nothing new
    refused = spark.read.parquet(rejects).collect()
    # What follows an entry that is no XML is refused with it, text and all.
    assert any("after" in (r.text or "") for r in refused)
    assert len(refused) == 2 and any("broken" in (r.text or "") for r in refused) and any(r.id == "d" for r in refused)
    assert all(r.feed_file.endswith("one.xml") for r in refused)

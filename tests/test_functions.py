import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates, text, urls, vectors
from gleanery.session import as_of_time, cutoff

SITE, BASE = "site.com", "https://www.site.com"


def apply(spark, values, use, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(use(F.col("v"))).collect()]


def at(*parts):
    return dt.datetime(*parts)


def test_normalise_url(spark):
    cases = {
        "https://www.site.com/news/a/?q#f": "https://www.site.com/news/a",
        " /news/a/../b\n": "https://www.site.com/news/b",
        "news//x": "https://www.site.com/news/x",
        "//cdn.site.com/y//": "https://cdn.site.com/y",
        "HTTP://www.site.com/A": "http://www.site.com/A",
        "/news/a;p=1": "https://www.site.com/news/a",
        "https://notsite.com/a": "https://notsite.com/a",
        "https://www.site.com/ü b": "https://www.site.com/ü b",
        "mailto:x@site.com": None,
        "ftp://site.com/a": None,
        "https://other.org/a": None,
        "https://www.site.com/": None,
        "#f": None,
        "?a=1": None,
        "": None,
        None: None,
    }
    got = apply(spark, list(cases), lambda c: urls.normalise_url(c, BASE, SITE))
    assert dict(zip(cases, got)) == cases


def test_normalise_url_by_domain(spark):
    given = ["https://site.com/a", "https://m.site.com:8080/a", "https://notsite.com/a", "https://site.com.evil.org/a"]
    got = apply(spark, given, lambda c: urls.normalise_url(c, BASE, SITE, "domain"))
    assert got == ["https://site.com/a", "https://m.site.com:8080/a", None, None]
    with pytest.raises(ValueError):
        urls.normalise_url(F.col("v"), BASE, SITE, "other")


def test_article_url(spark):
    cases = {
        "/news/some-story": True,
        "/news/team/some-story": True,
        "/news/category/top": False,
        "/news/categoryless": False,
        "/news/author/x": False,
        "/news/author": True,
        "/news/tag/x": False,
        "/news/archive-2020": False,
        "/news/writer-archive": False,
        "/news/newsletters": False,
        "/news/x/home": False,
        "/news/news": False,
        "/video/x": False,
        "/news": False,
    }
    got = apply(spark, [BASE + p for p in cases], urls.is_article_url)
    assert dict(zip(cases, got)) == cases


def test_url_id_and_feed_address(spark):
    assert apply(spark, [BASE + "/news/a-b"], urls.url_id) == ["a-b"]
    got = apply(spark, ["https://v.com/channel/UC1"], lambda c: urls.feed_address(c, "https://v.com/f?id="))
    assert got == ["https://v.com/f?id=UC1"]


def test_parse_datetime(spark):
    cases = {
        "2024-03-05T10:00:00Z": at(2024, 3, 5, 10),
        "on 2024-03-05T10:00:00.1234567-0530 there": at(2024, 3, 5, 15, 30, 0, 123456),
        "2024-03-05T10:00:00+05:30": at(2024, 3, 5, 4, 30),
        "2024-03-05T10:00:00": at(2024, 3, 5, 10),
        "2024-03-05": None,
        "2024-13-05T10:00:00Z": None,
        "March 5, 2024 7:05 PM": at(2024, 3, 5, 19, 5),
        "mar  05,\n2024 12:00 am": at(2024, 3, 5),
        "September 5, 2024": at(2024, 9, 5),
        "Sept 5, 2024": None,
        "March 5, 2024 7:05PM": None,
        "March 5, 2024 13:05 PM": None,
        "February 30, 2024": None,
        "soon": None,
        "": None,
        None: None,
    }
    assert dict(zip(cases, apply(spark, list(cases), dates.parse_datetime))) == cases


def test_feed_datetime_has_fixed_zones(spark):
    cases = {
        "Wed, 02 Oct 2002 13:00:00 GMT": at(2002, 10, 2, 13),
        "Tue, 5 Mar 2024 10:05:00 EST": at(2024, 3, 5, 15, 5),
        "Sun, 7 Jul 2024 10:05:00 EST": at(2024, 7, 7, 15, 5),
        "Sun, 7 Jul 2024 10:05:00 EDT": at(2024, 7, 7, 14, 5),
        "5 Mar 2024 10:05 -0500": at(2024, 3, 5, 15, 5),
        "2024-03-05T10:00:00+00:00": at(2024, 3, 5, 10),
        "junk": None,
    }
    assert dict(zip(cases, apply(spark, list(cases), dates.feed_datetime))) == cases


def test_dates_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        given = ["2024-03-10T02:30:00Z", "March 10, 2024 2:30 AM"]
        assert apply(spark, given, dates.parse_datetime) == [at(2024, 3, 10, 2, 30)] * 2
        start = spark.range(1).select(cutoff("2024-03-10 12:00:00", 24)).first()[0]
        assert start == at(2024, 3, 9, 12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_as_of_time():
    assert as_of_time("2024-01-02T03:04:05+02:00") == at(2024, 1, 2, 1, 4, 5)
    assert as_of_time(at(2024, 1, 2)) == at(2024, 1, 2)
    assert as_of_time().tzinfo is None


def test_texts(spark):
    assert apply(spark, [" a  \n b ", None, ""], text.clean_text) == ["a b", "", ""]
    both = lambda c: text.first_non_empty(F.lit(None).cast("string"), F.lit(" \n"), c, F.lit("z"))
    assert apply(spark, ["x", " "], both) == ["x", "z"]
    marked = ["Lead Content: a Content: b ", " plain "]
    assert apply(spark, marked, text.after_marker) == ["a Content: b", "plain"]
    assert apply(spark, ["<a&b>\"'"], text.html_escape) == ["&lt;a&amp;b&gt;&quot;&#x27;"]
    # Short ones lose, title words count double, and the order is that of the text.
    sentences = ["One. Some more words here! Three? The Storm, a day later. Last words of it.", "no end", ""]
    best = lambda c: text.best_sentences(c, F.lit("storm a night"), 3)
    assert apply(spark, sentences, best) == [
        "Some more words here! The Storm, a day later. Last words of it.", "no end", ""
    ]
    assert apply(spark, ["a b  c d"], lambda c: text.first_words(c, 3)) == ["a b c"]


def test_parse_vector(spark):
    cases = {
        None: None, "": None, "bad": None, "5": None, "[]": None, "[[1.0]]": None, '{"a":1}': None,
        '["1.5"]': None, "[null,1]": [None, 1.0], "[0,0]": [0.0, 0.0], "[1,2.5]": [1.0, 2.5],
    }
    assert dict(zip(cases, apply(spark, list(cases), vectors.parse_vector))) == cases
    usable = apply(spark, list(cases), lambda c: vectors.is_comparable(vectors.parse_vector(c)))
    assert [c for c, u in zip(cases, usable) if u] == ["[1,2.5]"]


def test_cosine(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.96, 0.0])
    unit = rows.select(vectors.unit_vector(F.col("a"))).collect()
    assert [list(r[0]) for r in unit] == [[0.6, 0.8], [0.0, 0.0]]

import datetime as dt
import time

import pytest

from gleanery.functions.html import PageRules, read_links, read_page
from gleanery.functions.jsonld import article_fields, listed_urls
from gleanery.operators.articles import page_articles, with_page_content
from gleanery.operators.links import linked_pages, page_links
from gleanery.sources.pages import landed_pages

BASE, SITE = "https://www.site.com", "site.com"


def ld(body):
    return f'<script type="application/ld+json">{body}</script>'


def articles(spark, pages, **kw):
    rows = spark.createDataFrame([(f"{BASE}/news/{k}", v) for k, v in pages.items()], "url string, html string")
    kw = {"as_of": "2024-03-06", "hours": None, **kw}
    return {r["id"]: r for r in page_articles(rows, BASE, SITE, **kw).collect()}


DATE = '<meta property="article:published_time" content="2024-03-05T10:00:00Z">'


def test_title_and_description_precedence(spark):
    got = articles(
        spark,
        {
            "ld": DATE + ld('{"@graph":[{"@type":"Person"},{"@type":["X","Article"],"headline":" L\\n1 ","description":"D"}]}')
            + '<meta property="og:title" content="og"><h1>h</h1>',
            "og": DATE + '<meta property="og:title" content="og"><meta name="twitter:title" content="tw">'
            + '<meta name="description" content="plain"><meta property="og:description" content="">',
            "tw": DATE + '<meta property="og:title"><meta property="og:title" content="second">'
            + '<meta name="twitter:title" content="t&amp;w"><meta name="twitter:description" content="twd">',
            "h1": DATE + "<h1>One <b>two</b>\n</h1><h1>other</h1>",
            "none": DATE + "<p>text</p>",
            "undated": "<h1>t</h1>",
        },
    )
    assert {k: (v["title"], v["description"]) for k, v in got.items()} == {
        "ld": ("L 1", "D"),
        "og": ("og", "plain"),
        "tw": ("t&w", "twd"),
        "h1": ("One two", ""),
    }


def test_date_precedence(spark):
    def meta(kind, name, content):
        return f'<meta {kind}="{name}" content="{content}">'

    h = "<h1>t</h1>"
    got = articles(
        spark,
        {
            "mod": h + ld('{"@type":"NewsArticle","datePublished":"2024-03-01T00:00:00Z","dateModified":"2024-03-02T00:00:00"}'),
            "pub": h + ld('{"@type":"NewsArticle","datePublished":"2024-03-01T00:00:00Z","dateModified":"soon"}') + DATE,
            "meta": h + DATE + meta("property", "article:modified_time", "2024-03-04T01:00:00+01:00"),
            "name": h + meta("itemprop", "datePublished", "2024-03-03T00:00:00Z") + meta("name", "date", "Mar 2, 2024"),
            "item": h + meta("itemprop", "datePublished", "2024-03-03T00:00:00Z"),
            "time": h + '<time>x</time><time datetime="bad"></time><time datetime="2024-03-05T07:00:00Z"></time>',
            "text": h + "<div>published ON March 5,\n2024 7:05 pm</div>",
            "colon": h + "<p>Updated: March 5, 2024 8:05 PM Published on March 4, 2024 9:00 AM</p>",
            "hidden": h + "<script>var x = 'Updated on March 5, 2024 7:05 PM'</script>",
            "any": h + ld('{"@type":"Article","video":{"uploadDate":"2024-03-01T09:00:00-02:00"}}'),
            "other": h + ld('{"@type":"VideoObject","dateModified":"2024-03-01T09:00:00Z"}'),
        },
    )
    at = dt.datetime
    assert {k: v["published_date"] for k, v in got.items()} == {
        "mod": at(2024, 3, 2),
        "pub": at(2024, 3, 1),
        "meta": at(2024, 3, 4),
        "name": at(2024, 3, 2),
        "item": at(2024, 3, 3),
        "time": at(2024, 3, 5, 7),
        "text": at(2024, 3, 5, 19, 5),
        "colon": at(2024, 3, 4, 9),
        "any": at(2024, 3, 1, 11),
    }


def test_content(spark):
    h = DATE + "<h1>t</h1>"
    got = articles(
        spark,
        {
            "body": h + ld('{"@type":"Article","articleBody":" a\\n b "}') + "<article><p>x</p></article>",
            "class": h + '<article><p>outer</p></article><div class="z ArticleContent_article__1"><p>in</p></div>',
            "blocks": h + "<article><h2>no</h2><p>one<br>two<aside><p>ad</p></aside><p class='ImgCaption'>c</p>"
            "<ul><li><p>three</p></li><li>four</ul><p> </p></article><main><p>m</p></main>",
            "plain": h + "<article> just <b>text</b></article>",
            "main": h + "<article></article><main><p>m</p></main>",
            "empty": h + "<p>outside</p>",
        },
    )
    assert {k: v["content"] for k, v in got.items()} == {
        "body": "a b",
        "class": "in",
        "blocks": "one two\n\nthree\n\nthree\n\nfour",
        "plain": "just text",
        "main": "m",
        "empty": "",
    }


def test_unclosed_blocks_can_nest():
    html = "<article><p><b>one<br><p>two</p><p>three</article>"
    assert read_page(html, PageRules()).by_article.value() == ["one", "two", "three"]
    nested = read_page(html, PageRules(implied_end_tags=False)).by_article.value()
    assert nested == ["one two three", "two", "three"]


def test_lookback_is_inclusive(spark):
    pages = {"a": DATE + "<h1>t</h1>"}
    assert articles(spark, pages, as_of="2024-03-06 10:00:00", hours=24)
    assert not articles(spark, pages, as_of="2024-03-06 10:00:01", hours=24)


def test_structured_data():
    bad = 'var a = {"@id": "/news/s"}; {nope} {"url": "/news/t", "item": {"url": "/news/u"}};'
    assert listed_urls(['{"item":{"url":"u"},"url":"v","@id":3}', "", "nothing"]) == ["v", "u", "u"]
    # The shortest snippet ends at the first brace, so the nested one does not parse.
    assert listed_urls([bad]) == ["/news/s"]
    assert article_fields(['[{"@type":"Thing"}]']) is None


def test_page_links(spark):
    pages = {
        "list": ld('{"itemListElement":[{"item":{"url":"/news/a?x"}},{"url":"/news/b#c"},{"url":"/news/tag/x"}]}') + '<a href="/news/z">z</a>',
        "foreign": ld('{"url":"https://other.org/news/a"}') + "<a class='q' href='/news/c?a=1&amp;b=2'>c</a>",
        "anchors": "<script>'<a href=\"/news/no\">'</script><!-- <a href='/news/no2'> --><A HREF=/news/d>d</A>"
        '<a data-href="/news/no3">x</a><a href="/news/d">again</a><a href="/news/author/x">x</a><a href="/news/home">h</a>',
        "none": "<p>x</p>",
    }
    rows = spark.createDataFrame([*pages.items(), ("missing", None)], "url string, html string")
    links = page_links(rows, BASE, SITE)
    got = {}
    for r in links.orderBy("page_url", "pos").collect():
        got.setdefault(r["page_url"], []).append(r["url"].removeprefix(BASE + "/news/"))
    assert got == {"list": ["a", "a", "b"], "foreign": ["c"], "anchors": ["d", "d"]}

    landed = spark.createDataFrame([(f"{BASE}/news/a/", "A"), (f"{BASE}/news/q", "Q")], "url string, html string")
    assert [tuple(r) for r in linked_pages(links, landed, BASE, SITE).collect()] == [(f"{BASE}/news/a", "A")]


def test_missing_pages(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "url string, html string")
    assert [r["url"] for r in landed_pages(rows).collect()] == ["a"]
    with pytest.raises(Exception, match="no HTML for page b"):
        landed_pages(rows, "fail").collect()
    with pytest.raises(ValueError):
        landed_pages(rows, "maybe")


def test_feed_page_content(spark):
    items = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u3")], "id string, url string")
    pages = spark.createDataFrame(
        [("u1", '<div class="x article-body">A Content: <p>b <i>c</i></p></div><p>d</p>'), ("u2", "<p>no body</p>")],
        "url string, html string",
    )
    got = {r["id"]: r["content"] for r in with_page_content(items, pages).collect()}
    assert got == {"1": "b c", "2": "", "3": ""}


def test_links_of_hostile_markup():
    page = read_links(
        '<!-- <script type="application/ld+json">{"url":"/hidden"}</script> -->'
        '<a title="x > y" href="/one">1</a><a class="c"href=/two>2</a><a href="/caf&eacute;&#45;x">3</a>'
        '<script>var a = "<a href=/four>";</script><a name="five">5</a><a href="">6</a>'
    )
    assert page.anchors == ["/one", "/two", "/café-x"] and page.scripts == []


def test_structured_data_of_any_depth_and_half_characters():
    deep = '{"a":[' * 20000
    assert listed_urls([deep]) == []
    assert listed_urls(['{"url":"/x\\ud800y"}']) == ["/x�y"]
    assert listed_urls(['{"url":"/\\ud83d\\ude00"}']) == ["/\U0001f600"]
    nested = '{"@type":"Article","headline":"h\\udfff","x":' + "[" * 900 + "]" * 900 + "}"
    assert article_fields([deep, nested])["headline"] == "h�"
    assert listed_urls(['{' * 200_000]) == []


def test_unclosed_markup_takes_linear_time():
    def seconds(n):
        html = "<article>" + "<b>" * n + "<li><ul>" + "<i>" * n + "<li>x</li>" * n + "</u>" * n + "{" * n
        start = time.process_time()
        read_page(html, PageRules())
        return time.process_time() - start

    seconds(2000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.02)


def test_a_task_holds_what_it_read_of_few_pages():
    from gleanery.operators import links
    import pyarrow as pa

    html = [f'<a href="/news/{i}">x</a>' for i in range(1_000)]
    batch = pa.RecordBatch.from_pydict({"url": [str(i) for i in range(1_000)], "html": html})
    pieces = list(links.found_urls(iter([batch])))
    assert max(p.num_rows for p in pieces) <= links.PAGES_HELD
    rows = [r for p in pieces for r in p.to_pylist()]
    assert rows == [{"url": str(i), "listed": [], "anchors": [f"/news/{i}"]} for i in range(1_000)]

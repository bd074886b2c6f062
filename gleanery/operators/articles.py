"""Raw pages to articles, and feed entries joined with the text of their page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.dates import first_datetime, iso_datetime
from gleanery.functions.html import PageRules
from gleanery.functions.text import after_marker, clean_text, first_non_empty
from gleanery.functions.urls import normalise_url, url_id
from gleanery.session import cutoff
from gleanery.sources.pages import page_fields


def _meta(kind: str, name: str) -> Column:
    return F.col("meta").getItem(f"{kind}:{name}")


def article_title() -> Column:
    return first_non_empty(
        F.col("ld.headline"), _meta("property", "og:title"), _meta("name", "twitter:title"), F.col("h1")
    )


def article_description() -> Column:
    return first_non_empty(
        F.col("ld.description"),
        _meta("property", "og:description"),
        _meta("name", "description"),
        _meta("name", "twitter:description"),
    )


def article_date() -> Column:
    """Structured dates (modified before published), meta tags, ``time`` tags, visible text;
    last, any ISO date in the structured article object."""
    stated = F.array(
        F.col("ld.modified"),
        F.col("ld.published"),
        _meta("property", "article:modified_time"),
        _meta("property", "article:published_time"),
        _meta("name", "date"),
        _meta("itemprop", "dateModified"),
        _meta("itemprop", "datePublished"),
    )
    given = first_datetime(F.concat(stated, "times", "visible_dates"))
    return F.coalesce(given, iso_datetime(F.col("ld.any_date")))


def article_content() -> Column:
    """Structured body, else the blocks of the first container that has text."""
    containers = [
        F.nullif(F.array_join(name, "\n\n"), F.lit(""))
        for name in ("class_blocks", "article_blocks", "main_blocks")
    ]
    body = F.nullif(clean_text(F.col("ld.body")), F.lit(""))
    return F.coalesce(body, *containers, F.lit(""))


def page_articles(
    pages: DataFrame,
    base: str,
    site: str,
    as_of=None,
    hours: float | None = 24,
    host_match: str = "contains",
    rules: PageRules = PageRules(),
    source_type: str = "page",
) -> DataFrame:
    """Articles of raw pages (url, html) dated at or after ``as_of - hours``.

    A page needs a usable URL, a title and a date. The URL test runs before the
    HTML is handed to Python; the date is only known afterwards.
    """
    usable = pages.filter(normalise_url(F.col("url"), base, site, host_match).isNotNull())
    url = normalise_url(F.col("url"), base, site, host_match)
    articles = (
        page_fields(usable, rules)
        .select(
            F.lit(source_type).alias("source_type"),
            url.alias("url"),
            article_title().alias("title"),
            article_description().alias("description"),
            article_date().alias("published_date"),
            article_content().alias("content"),
        )
        .withColumn("id", url_id(F.col("url")))
    )
    if hours is None:
        dated = F.col("published_date").isNotNull()
    else:
        dated = F.col("published_date") >= cutoff(as_of, hours)
    return articles.filter((F.col("title") != "") & dated).select(
        "source_type", "id", "title", "description", "url", "published_date", "content"
    )


def with_page_content(items: DataFrame, pages: DataFrame, rules: PageRules = PageRules()) -> DataFrame:
    """Feed items with ``content`` from their page's body; ``""`` when page or body is absent.

    Only pages that an item refers to are read. Of a page landed more than once the longest body
    counts, of equally long ones the greatest, so an item stays one row.
    """
    wanted = pages.join(items.select("url"), "url", "left_semi")
    longest = F.max(F.struct(F.length("body_text").alias("size"), "body_text"))
    bodies = page_fields(wanted, rules).groupBy("url").agg(longest.alias("one")).select("url", "one.body_text")
    text = F.coalesce("body_text", F.lit(""))
    return items.join(bodies, "url", "left").withColumn("content", after_marker(text)).drop("body_text")

"""Candidate article URLs of listing pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.html import read_links
from gleanery.functions.jsonld import listed_urls, writable
from gleanery.functions.urls import (
    ARTICLE_PREFIX,
    EXCLUDED_PREFIXES,
    EXCLUDED_SLUGS,
    is_article_url,
    normalise_url,
)

# Pages of which a task holds what it read; their links go on before the next are read.
PAGES_HELD = 64


def found_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """URLs in a page's structured data, and ``href`` of its anchors, in page order; of (url, html)."""
    lists = pa.list_(pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_HELD):
            piece = batch.slice(at, PAGES_HELD)
            pages = [read_links(text) for text in piece.column("html").to_pylist()]
            listed = pa.array([listed_urls(page.scripts) for page in pages], lists)
            anchors = pa.array([[writable(url) for url in page.anchors] for page in pages], lists)
            yield pa.RecordBatch.from_arrays([piece.column("url"), listed, anchors], ["url", "listed", "anchors"])


def page_links(
    pages: DataFrame,
    base: str,
    site: str,
    host_match: str = "contains",
    prefix: str = ARTICLE_PREFIX,
    excluded_prefixes: Sequence[str] = EXCLUDED_PREFIXES,
    excluded_slugs: Sequence[str] = EXCLUDED_SLUGS,
) -> DataFrame:
    """(page_url, pos, url): article URLs of each page (url, html), duplicates kept.

    Structured data counts if any of its URLs passes the filter, anchors otherwise.
    Pages are read once, by the same parser that reads articles.
    """

    def usable(urls: Column) -> Column:
        normal = F.transform(urls, lambda u: normalise_url(u, base, site, host_match))
        return F.filter(
            normal,
            lambda u: u.isNotNull() & is_article_url(u, prefix, excluded_prefixes, excluded_slugs),
        )

    found = (
        pages.filter(F.col("html").isNotNull())
        .select("url", "html")
        .mapInArrow(found_urls, "url string, listed array<string>, anchors array<string>")
        .select("url", "anchors", usable(F.col("listed")).alias("listed"))
    )
    urls = F.when(F.size("listed") > 0, F.col("listed")).otherwise(usable(F.col("anchors")))
    # The outer form, as for the plain one Spark would find the links once more to filter on them.
    links = found.select("url", urls.alias("urls")).select(
        F.col("url").alias("page_url"), F.posexplode_outer("urls").alias("pos", "url")
    )
    return links.filter(F.col("url").isNotNull())


def linked_pages(links: DataFrame, pages: DataFrame, base: str, site: str, host_match: str = "contains") -> DataFrame:
    """Pages that some link points at; a link whose page was not landed is dropped."""
    keyed = pages.withColumn("link", normalise_url(F.col("url"), base, site, host_match))
    wanted = links.select(F.col("url").alias("link"))
    return keyed.join(wanted, "link", "left_semi").select(F.col("link").alias("url"), "html")

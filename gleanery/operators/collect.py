"""The collection job: landed feeds, channels and pages to one batch for the item table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.html import PageRules
from gleanery.functions.urls import normalise_url
from gleanery.operators.articles import page_articles, with_page_content
from gleanery.operators.links import linked_pages, page_links
from gleanery.operators.pending import source_counts
from gleanery.schemas import ITEM_BATCH
from gleanery.session import freeze_table
from gleanery.sources.transcripts import with_transcripts


@dataclass(frozen=True)
class Site:
    """A site whose listing pages lead to articles."""

    base: str
    name: str
    host_match: str = "contains"
    rules: PageRules = field(default_factory=PageRules)
    links: dict = field(default_factory=dict)  # prefix and exclusions of article addresses


def frontier(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(url) of the articles that listing pages name, each once, less those already known (url)."""
    found = links.select("url").distinct()
    return found if known is None else found.join(known.select("url"), "url", "left_anti")


def site_articles(
    listings: DataFrame, pages: DataFrame, site: Site, as_of=None, hours: float | None = 24, known: DataFrame | None = None
) -> DataFrame:
    """Articles of the landed ``pages`` (url, html) that the ``listings`` (url, html) lead to.

    Pages that could not be fetched are passed by. Known addresses are not read again.
    """
    named = frontier(page_links(listings, site.base, site.name, site.host_match, **site.links), known)
    return page_articles(
        linked_pages(named, pages, site.base, site.name, site.host_match), site.base, site.name, as_of, hours, site.host_match, site.rules
    )


def known_urls(items: DataFrame, site: Site) -> DataFrame:
    return items.select(normalise_url(F.col("url"), site.base, site.name, site.host_match).alias("url")).filter("url is not null")


def collect_batch(
    feed_items: DataFrame,
    channel_items: DataFrame,
    snippets: DataFrame,
    pages: DataFrame,
    articles: DataFrame,
    feed_rules: PageRules = PageRules(),
) -> tuple[DataFrame, DataFrame]:
    """One batch for `store.upsert_items`, kept in the shared folder, and its rows per source type.

    Feed entries get the content of their page, channel entries their transcript; ``articles``
    come as they are. A key that occurs twice stays twice, as the upsert counts and resolves it:
    the later published wins, then the greater title and content.
    """
    entries = with_page_content(feed_items, pages, feed_rules)
    videos = with_transcripts(channel_items, snippets)
    batch = None
    for rows in (entries, videos, articles):
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ITEM_BATCH.fields if f.name not in rows.columns]
        rows = rows.select("*", *missing).select(*ITEM_BATCH.names)
        batch = rows if batch is None else batch.unionByName(rows)
    # Entries without a key, a title or a date are no items.
    usable = [F.col(f.name).isNotNull() for f in ITEM_BATCH.fields if not f.nullable]
    for test in usable:
        batch = batch.filter(test)
    position = F.struct("published_date", "title", F.coalesce("content", F.lit("")).alias("content"))
    batch = freeze_table(batch.withColumn("batch_pos", position), "collected")
    return batch, source_counts(batch, ["page", "rss", "video"])

"""Raw pages: the landed table, and the fields read out of each page's HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import jsonld
from gleanery.functions.html import PageRules, read_page
from gleanery.functions.jsonld import writable

# Pages whose fields a task holds; they go on before the next pages are read.
PAGES_HELD = 64

_TEXTS = T.ArrayType(T.StringType())

PAGE_FIELDS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField(
            "ld",
            T.StructType(
                [
                    T.StructField(name, T.StringType())
                    for name in ("headline", "description", "body", "modified", "published", "any_date")
                ]
            ),
        ),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("h1", T.StringType()),
        T.StructField("times", _TEXTS),
        T.StructField("visible_dates", _TEXTS),
        T.StructField("class_blocks", _TEXTS),
        T.StructField("article_blocks", _TEXTS),
        T.StructField("main_blocks", _TEXTS),
        T.StructField("body_text", T.StringType()),
    ]
)


def landed_pages(pages: DataFrame, on_missing: str = "skip") -> DataFrame:
    """Pages as (url, html). A page without HTML is skipped, or with ``fail`` ends the job."""
    if on_missing == "skip":
        return pages.select("url", "html").filter(F.col("html").isNotNull())
    if on_missing == "fail":
        missing = F.raise_error(F.concat(F.lit("no HTML for page "), F.col("url")))
        return pages.select("url", F.coalesce("html", missing.cast("string")).alias("html"))
    raise ValueError(f"on_missing must be 'skip' or 'fail', not {on_missing!r}")


def page_fields(pages: DataFrame, rules: PageRules = PageRules()) -> DataFrame:
    """Fields of each page (url, html), read in Arrow batches; the HTML itself is not kept.

    A page without HTML could not be fetched and is skipped.
    """

    def fields(url: str, html: str) -> dict:
        page = read_page(html, rules)
        blocks = {
            "class_blocks": page.by_class,
            "article_blocks": page.by_article,
            "main_blocks": page.by_main,
        }
        return {
            "url": url,
            "ld": jsonld.article_fields(page.scripts),
            "meta": {writable(k): v if v is None else writable(v) for k, v in page.meta.items()},
            "h1": page.h1.value() if page.h1 else None,
            "times": page.times,
            "visible_dates": page.visible_dates(),
            **{name: box.value() if box else [] for name, box in blocks.items()},
            "body_text": " ".join(page.body.parts) if page.body else "",
        }

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PAGES_HELD):
                piece = batch.iloc[at : at + PAGES_HELD]
                rows = [fields(u, h) for u, h in zip(piece["url"], piece["html"])]
                yield pd.DataFrame(rows, columns=PAGE_FIELDS.names)

    return landed_pages(pages).mapInPandas(read, PAGE_FIELDS)

"""Ranked summaries with their sources, and one digest per profile and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.dates import date_label
from gleanery.functions.once import bound
from gleanery.functions.text import html_escape, strip
from gleanery.operators.rank import all_phrases, found_phrases, padded_form, reasoning
from gleanery.schemas import RANKED_COLUMNS
from gleanery.session import freeze_table, ntz

TITLE = "News Daily Summary"
HEADING = "News Articles"
NO_NAME = "there"
# Characters of texts that are broadcast to the rows that want them: 32 million.
TEXTS_SENT = 32_000_000


def record_json(**fields: Column) -> Column:
    """A summary as JSON for a ranking model; dates in ISO form."""
    values = [
        (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if name.endswith("_at") else c.cast("string")).alias(name)
        for name, c in fields.items()
    ]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def with_texts(rows: DataFrame, texts: DataFrame, size: Column) -> DataFrame:
    """``rows`` joined by id with the few ``texts`` they refer to, each of ``size`` characters.

    Stored tables say how large they are packed, so a table of many short or repeated values
    passes for a small one: without a word Spark would broadcast the rows. Texts up to
    `TEXTS_SENT` are sent to the rows, which then stay where they are; others meet them by id.
    """
    texts = freeze_table(texts, "texts")
    total = texts.agg(F.sum(size + 200)).first()[0] or 0
    return rows.join(F.broadcast(texts) if total <= TEXTS_SENT else texts.hint("merge"), "id")


def ranked_records(ranked: DataFrame, summaries: DataFrame, items: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Top-n rows (profile_id, id, rank, relevance_score[, reasoning]) with summary and URL.

    Rows whose id is unknown are dropped after the cut, so fewer than n can remain.
    A source without a stored item has the URL ``""``. With ``profiles`` the
    reasoning names the phrases found.
    """
    ranked = freeze_table(ranked, "ranked")
    told = summaries.join(ranked.select("id").distinct(), "id", "left_semi").select(
        "id", "title", F.col("summary_text").alias("summary"), "source_id", "source_type", "article_created_at"
    )
    size = F.length("title") + F.length("summary")
    if profiles is not None:
        # Once per summary, before the join repeats it for each profile that ranks it.
        told = told.withColumn("padded", padded_form(F.col("title"), F.col("summary")))
        size = size + F.length("padded")
        # Phrases come before the texts, so that rows are dealt by profile without them.
        asked = profiles.select("profile_id", all_phrases().alias("phrases"))
        ranked = ranked.join(asked.hint("merge"), "profile_id")
    # Ranked summaries are few beside the item table: the items are cut to the sources that are
    # wanted (a broadcast where that side is small) before the join that keeps missing ones.
    told = freeze_table(told, "told")
    source = ["source_type", "source_id"]
    wanted = told.select(*source).distinct()
    urls = items.select("source_type", F.col("id").alias("source_id"), "url").join(wanted, source, "left_semi")
    texts = told.join(urls, source, "left").withColumn("url", F.coalesce("url", F.lit("")))
    full = with_texts(ranked, texts, size + F.length("url"))
    if profiles is not None:
        found = found_phrases(F.col("phrases"), F.col("padded"))
        full = full.withColumn("reasoning", bound(found, reasoning))
    return full.select(*RANKED_COLUMNS)


def greeting(name: Column, label: Column) -> Column:
    return F.concat(F.lit("Hi "), F.coalesce(name, F.lit(NO_NAME)), F.lit(" - happy "), label, F.lit("!"))


def introduction(titles: Column, count: Column) -> Column:
    """What the digest holds, with its first three titles."""
    return F.concat(
        F.lit("Today's digest has "),
        count.cast("string"),
        F.when(count == 1, F.lit(" story")).otherwise(F.lit(" stories")),
        F.lit(". It opens with: "),
        F.array_join(F.slice(titles, 1, 3), "; "),
        F.lit("."),
    )


def _paragraphs(text: Column) -> Column:
    """Plain text as HTML: blank lines part paragraphs, line ends are breaks."""
    parted = F.regexp_replace(html_escape(strip(text)), r"\n[ \t]*\n\s*", "</p>\n<p>")
    return F.concat(F.lit("<p>"), F.regexp_replace(parted, r"(?<!>)\n", "<br>\n"), F.lit("</p>"))


def _text_item(item: Column) -> Column:
    more = F.when(item["url"] != "", F.concat(F.lit("\nRead more: "), item["url"]))
    return F.concat(
        item["rank"].cast("string"), F.lit(". "), item["title"], F.lit("\n"), strip(item["summary"]), F.coalesce(more, F.lit("")), F.lit("\n")
    )


def _html_item(item: Column) -> Column:
    more = F.when(
        item["url"] != "",
        F.concat(F.lit('\n<p><a href="'), html_escape(item["url"]), F.lit('">Read more</a></p>')),
    )
    return F.concat(
        F.lit("<section>\n<h3>"),
        item["rank"].cast("string"),
        F.lit(". "),
        html_escape(item["title"]),
        F.lit("</h3>\n"),
        _paragraphs(item["summary"]),
        F.coalesce(more, F.lit("")),
        F.lit("\n</section>"),
    )


def digests(
    records: DataFrame,
    profiles: DataFrame,
    as_of=None,
    title: str = TITLE,
    heading: str = HEADING,
    intro: Column | None = None,
) -> DataFrame:
    """One row per profile that has records; a profile without any gets no digest.

    ``intro`` replaces the introduction; it may use name, label, titles and n_items.
    Each group holds the profile's top-n rows only.
    """
    label = date_label(ntz(as_of))
    item = F.struct("rank", "id", "title", "summary", "url")
    grouped = records.groupBy("profile_id").agg(
        F.sort_array(F.collect_list(item)).alias("listed"), F.count("*").cast("int").alias("n_items")
    )
    # Both sides are dealt by profile; names of many profiles are not broadcast.
    names = profiles.select("profile_id", "name").hint("merge")
    named = grouped.join(names, "profile_id", "left").select(
        "profile_id",
        "name",
        "listed",
        "n_items",
        label.alias("label"),
        F.transform("listed", lambda x: x["title"]).alias("titles"),
    )
    opening = intro if intro is not None else introduction(F.col("titles"), F.col("n_items"))
    whole = named.withColumns({"hello": greeting(F.col("name"), F.col("label")), "opening": opening})
    top = F.concat(F.lit("Top "), F.col("n_items").cast("string"), F.lit(f" {heading} for "), F.col("label"))
    text = F.concat_ws(
        "\n",
        F.lit(title),
        F.lit(""),
        strip(F.col("hello")),
        strip(F.col("opening")),
        F.lit(""),
        top,
        F.lit(""),
        F.array_join(F.transform("listed", _text_item), "\n"),
    )
    html = F.concat_ws(
        "\n",
        F.concat(F.lit("<h1>"), html_escape(F.lit(title)), F.lit("</h1>")),
        _paragraphs(F.col("hello")),
        _paragraphs(F.col("opening")),
        F.concat(F.lit("<h2>"), html_escape(top), F.lit("</h2>")),
        F.lit("<hr>"),
        F.array_join(F.transform("listed", _html_item), "\n<hr>\n"),
    )
    return whole.select(
        "profile_id",
        F.to_date(ntz(as_of)).alias("run_date"),
        "n_items",
        F.concat(F.lit(f"{title} - "), "label").alias("subject"),
        strip(text).alias("body_text"),
        html.alias("body_html"),
    )

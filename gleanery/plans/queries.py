"""One query per operator over the driver's test tables, whole tables each."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text, urls, vectors
from gleanery.operators import collect, digest, embed, latest, links, merge, model_rank, neardup, pending, rank, remember, similar, summarise
from gleanery.operators.articles import page_articles, with_page_content
from gleanery.plans import daily, views
from gleanery.plans.views import AS_OF
from gleanery.session import cutoff, freeze_table, ntz, scratch_path
from gleanery.sources import feeds, pages, profiles, store, transcripts
from gleanery.streaming import ingest

SITE, BASE = "example", "https://www.example.com"
SIMILAR = 0.35  # the test vectors are close to random; nothing reaches the default
WHOLE = 72  # hours that cover every derived item
PROFILE = {"teams": ["the", "des"], "players": ["of the"], "interests": ["that"]}


def _table(spark, sf_dir, name):
    return views.table(spark, sf_dir, name)


# --- windows, keys, upsert -------------------------------------------------------------


def items_lookback(spark, sf_dir):
    items = views.items(spark, sf_dir).filter(F.col("published_date") >= cutoff(AS_OF, 24))
    return items.select("source_type", "id", "title", "published_date")


def lookback_strict(spark, sf_dir):
    items = views.items(spark, sf_dir).filter(F.col("published_date") > cutoff("2024-01-03 13:37:00", 12))
    return items.select("source_type", "id", "published_date")


def latest_event(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts", "value")
    return latest.latest_per_key(events, ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")])


def _with_scripts(spark, sf_dir):
    return transcripts.with_transcripts(views.items(spark, sf_dir), views.snippets(spark, sf_dir))


def _summarised(spark, sf_dir):
    number = F.col("doc_id")
    return _table(spark, sf_dir, "labels").select(
        views.source_type(number).alias("source_type"), F.concat(F.lit("d"), number).alias("source_id")
    )


def pending_items(spark, sf_dir):
    open_items = pending.pending_items(_with_scripts(spark, sf_dir), _summarised(spark, sf_dir), AS_OF, WHOLE)
    return open_items.select("source_type", "id", "published_date")


def source_counts(spark, sf_dir):
    open_items = pending.pending_items(_with_scripts(spark, sf_dir), _summarised(spark, sf_dir), AS_OF, WHOLE)
    return pending.source_counts(open_items, ["page", "rss", "video", "radio"])


def transcript_texts(spark, sf_dir):
    return transcripts.transcripts(views.snippets(spark, sf_dir))


_ITEM_OUT = ["source_type", "id", "title", "description", "url", "published_date", "content", "created_at"]


def upsert_items(spark, sf_dir):
    merged = merge.merge_items(views.stored_items(spark, sf_dir), views.upsert_batch(spark, sf_dir), AS_OF)
    return merged.select(*_ITEM_OUT)


def upsert_counts(spark, sf_dir):
    return merge.upsert_counts(views.stored_items(spark, sf_dir), views.upsert_batch(spark, sf_dir))


def upsert_store(spark, sf_dir):
    """Through the stored table: first the items, then the batch, applied twice."""
    path = scratch_path(spark, "items")
    first = views.stored_items(spark, sf_dir).withColumn("batch_pos", F.lit(0).cast("long"))
    store.upsert_items(spark, path, first, "2024-01-03 12:00:00")
    for _ in range(2):
        store.upsert_items(spark, path, views.upsert_batch(spark, sf_dir), AS_OF)
    return store.read_items(spark, path, AS_OF, 24).select(*_ITEM_OUT)


# --- URLs and pages --------------------------------------------------------------------


def url_normalise(spark, sf_dir):
    url = urls.normalise_url(F.col("url"), BASE, SITE)
    return _table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def article_url_filter(spark, sf_dir):
    normal = url_normalise(spark, sf_dir)
    is_article = urls.is_article_url(F.col("url"), "/en/", ("/en/1", "/en/20"), ("en", "7"))
    return normal.filter(is_article).select("page_id", urls.url_id(F.col("url")).alias("article_id"))


def feed_addresses(spark, sf_dir):
    address = urls.feed_address(F.col("url"), "https://feeds.example.com/videos.xml?channel_id=")
    return _table(spark, sf_dir, "pages").select("page_id", address.alias("feed"))


def page_links(spark, sf_dir):
    found = links.page_links(_table(spark, sf_dir, "pages"), BASE, SITE, prefix="/", excluded_prefixes=("/a",))
    return found.select("page_url", "pos", "url")


def _listing_pages(spark, sf_dir):
    """Test pages with structured data: a list, text with good snippets, or only foreign links."""
    number = F.col("page_id").cast("string")
    whole = F.concat(
        F.lit('{"@type":"ItemList","@id":"/news/list-'), number,
        F.lit('/","itemListElement":[{"item":{"url":"/news/a-'), number,
        F.lit('?x=1"}},{"url":"https://www.example.com/news/tag/z"},{"url":"/news/b-'), number, F.lit('#c"}]}'),
    )
    broken = F.concat(F.lit('var x = {"url":"/news/s-'), number, F.lit('"}, {bad}, {"@id":"news/t"};'))
    foreign = F.lit('{"url":"https://elsewhere.org/news/a"}')
    kind = F.col("page_id") % 4
    data = F.when(kind == 0, whole).when(kind == 1, broken).when(kind == 2, foreign)
    script = F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>")), F.lit(""))
    anchor = F.concat(F.lit('<a class="x" href="/news/anchor-'), number, F.lit('?q=1&amp;r=2">more</a>'))
    return _table(spark, sf_dir, "pages").select("url", F.concat(script, "html", anchor).alias("html"))


def listing_links(spark, sf_dir):
    return links.page_links(_listing_pages(spark, sf_dir), BASE, SITE)


def hostile_pages(spark, sf_dir):
    """Links of pages with marks inside attributes, missing blanks, entities, structured data in
    a comment, half characters and nesting beyond any parser."""
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 3
    script = '<script type="application/ld+json">'
    deep = F.concat(F.lit(script), F.repeat(F.lit('{"a":['), F.lit(20000)), F.lit("</script>"))
    half = F.concat(F.lit(script + '{"url":"/news/half\\ud800-'), number, F.lit('"}</script>'))
    extra = F.concat(
        F.lit("<!-- " + script + '{"url":"/news/hidden"}</script> --><a title="x > y" href="/news/quoted-'), number,
        F.lit('">a</a><a class="c"href=/news/tight-'), number,
        F.lit('>b</a><a href="/news/caf&eacute;-'), number, F.lit('&#45;x">c</a>'),
    )
    data = F.when(F.col("page_id") % 30 == 0, deep).when(kind == 1, half).otherwise(F.lit(""))
    pages = _table(spark, sf_dir, "pages").select("url", F.concat("html", data, extra).alias("html"))
    return links.page_links(pages, BASE, SITE)


def linked_pages(spark, sf_dir):
    """Listed articles joined with their landed pages."""
    landed = _table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://www.example.com/news/a-"), (F.col("page_id") + 2).cast("string"), F.lit("/?p")).alias("url"),
        "html",
    )
    found = links.page_links(_listing_pages(spark, sf_dir), BASE, SITE)
    joined = links.linked_pages(found, landed, BASE, SITE)
    return joined.select("url", F.length("html").alias("n_chars"))


def _dated_pages(spark, sf_dir):
    """Test pages with a date in one of seven places, and structured or meta titles on some."""
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 7
    minute = F.lpad((F.col("page_id") % 60).cast("string"), 2, "0")
    day = F.col("page_id") % 28 + 1
    iso = F.concat(F.lit("2024-01-"), F.lpad(day.cast("string"), 2, "0"), F.lit("T10:"), minute, F.lit(":00"))
    written = F.concat(F.lit("January "), day.cast("string"), F.lit(", 2024 9:"), minute, F.lit(" PM"))
    head = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Thing","NewsArticle"],"headline":" Head  '),
                number, F.lit('","datePublished":"1999-01-01T00:00:00Z","dateModified":"'), iso,
                F.lit('.5+02:00","articleBody":""}]}</script>'),
            ),
        )
        .when(kind == 1, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('Z">')))
        .when(
            kind == 2,
            F.concat(
                F.lit('<meta property="og:title" content=" "><meta name="twitter:title" content="Tw &amp; '), number,
                F.lit('"><meta name="date" content="no date"><meta itemprop="dateModified" content="'), written,
                F.lit('"><meta name="description" content="About  '), number, F.lit('">'),
            ),
        )
        .when(kind == 3, F.concat(F.lit("<time>x</time><time datetime='soon'></time><time datetime='"), iso, F.lit("-05:30'></time>")))
        .when(kind == 4, F.concat(F.lit("<p>UPDATED on "), written, F.lit("</p>")))
        .when(kind == 5, F.concat(F.lit("<div>Published: "), written, F.lit(" </div>")))
        .otherwise(F.lit(""))
    )
    return _table(spark, sf_dir, "pages").select("url", F.concat(head, "html").alias("html"))


def page_articles_query(spark, sf_dir):
    found = page_articles(_dated_pages(spark, sf_dir), BASE, SITE, "2024-01-21 10:00:00", 240)
    return found.select("id", "url", "title", "description", "published_date", "content")


def page_titles(spark, sf_dir):
    fields = pages.page_fields(pages.landed_pages(_table(spark, sf_dir, "pages")))
    return fields.select("url", text.first_non_empty(F.col("h1")).alias("title"))


def clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


# --- feeds -----------------------------------------------------------------------------


def _rss_entries(spark, sf_dir):
    """The items as RSS entries, with dates in five zone spellings."""
    number = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    zone = F.element_at(
        F.array(*[F.lit(z) for z in ("GMT", "+0000", "-0500", "EST", "EDT")]), (number % 5 + 1).cast("int")
    )
    stamp = F.concat(F.date_format("published_date", "EEE, dd MMM yyyy HH:mm:ss "), zone)
    return views.items(spark, sf_dir).select(
        "source_type",
        F.struct(F.col("id").alias("_VALUE"), F.lit("false").alias("_isPermaLink")).alias("guid"),
        text.clean_text(F.col("title")).alias("title"),
        text.clean_text(F.col("description")).alias("description"),
        F.col("url").alias("link"),
        stamp.alias("pubDate"),
    )


def _landed(entries, path, root="channel", tag="item"):
    entries.write.format("xml").option("rootTag", root).option("rowTag", tag).mode("append").save(path)
    return path


def _rss_files(spark, sf_dir):
    return _landed(_rss_entries(spark, sf_dir).drop("source_type"), scratch_path(spark, "rss"))


def rss_items(spark, sf_dir):
    found = feeds.rss_items(spark, _rss_files(spark, sf_dir), AS_OF, 24)
    return found.select("source_type", "id", "title", "description", "url", "published_date")


def _atom_files(spark, sf_dir):
    """The items landed as channel feeds; every fourth is a short clip."""
    number = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    link = F.when(number % 4 == 0, F.concat(F.lit("https://v.example.com/shorts/"), "id")).otherwise(
        F.concat(F.lit("https://v.example.com/watch?v="), "id")
    )
    entries = views.items(spark, sf_dir).select(
        F.col("id").alias("videoId"),
        text.clean_text(F.col("title")).alias("title"),
        F.struct(F.lit("alternate").alias("_rel"), link.alias("_href")).alias("link"),
        F.concat(F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("published"),
        F.struct(text.clean_text(F.col("description")).alias("description")).alias("group"),
    )
    return _landed(entries, scratch_path(spark, "atom"), "feed", "entry")


def atom_items(spark, sf_dir):
    found = feeds.atom_items(spark, _atom_files(spark, sf_dir), AS_OF, 24)
    return found.select("source_type", "id", "title", "description", "url", "published_date")


def feed_page_content(spark, sf_dir):
    """Feed entries joined with the body of their page; every third page has none."""
    table = _table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    entries = table.select(F.concat(F.lit("e"), number).alias("id"), "url").unionByName(
        table.select(F.concat(F.lit("x"), number).alias("id"), F.concat("url", F.lit("&gone")).alias("url"))
    )
    body = F.concat(
        F.lit('<div class="wide article-body">Lead <i>'), number, F.lit("</i> Content: <p>Body <b>of</b> "), number,
        F.lit(" &amp; Content: more</p></div>"),
    )
    plain = F.concat(F.lit('<div class="article-body"> Only '), number, F.lit(" </div>"))
    head = F.when(F.col("page_id") % 3 == 0, body).when(F.col("page_id") % 3 == 1, plain).otherwise(F.lit(""))
    landed = table.select("url", F.concat(head, "html").alias("html"))
    return with_page_content(entries, landed).select("id", "url", "content")


def missing_pages(spark, sf_dir):
    """Feed entries and pages of which some could not be fetched and some were landed twice."""
    table = _table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    entries = table.select(F.concat(F.lit("e"), number).alias("id"), "url")
    body = F.concat(F.lit('<div class="article-body">Content: '), number, F.lit("</div>"))
    landed = table.select("page_id", "url", F.when(F.col("page_id") % 5 != 0, F.concat(body, "html")).alias("html"))
    longer = F.regexp_replace("html", "^(.*?)</div>", "$1 and more</div>")
    twice = landed.filter("page_id % 7 = 0").select("page_id", "url", longer.alias("html"))
    return with_page_content(entries, landed.unionByName(twice)).select("id", "url", "content")


def strict_pages(spark, sf_dir):
    """Pages that must all be there."""
    landed = pages.landed_pages(_table(spark, sf_dir, "pages"), on_missing="fail")
    return landed.select("url", F.length("html").alias("n_chars"))


def source_addresses(spark, sf_dir):
    kind = F.when(F.col("page_id") % 2 == 0, F.lit("video")).otherwise(F.lit("rss")).alias("source_type")
    table = _table(spark, sf_dir, "pages").select(kind, F.col("url").alias("address"))
    return feeds.landing_addresses(table, "https://feeds.example.com/videos.xml?channel_id=")


SECTION = collect.Site(BASE, SITE)


def _collected(spark, sf_dir):
    """Feeds, channels and a section of articles, landed and collected. Of the articles listed, those
    of every third page are known; some pages could not be fetched."""
    rss = _landed(_rss_entries(spark, sf_dir).filter("source_type = 'rss'").drop("source_type"), scratch_path(spark, "rss"))
    items = feeds.rss_items(spark, rss, AS_OF, 24)
    channels = feeds.atom_items(spark, _atom_files(spark, sf_dir), AS_OF, 24)
    number = F.col("page_id")
    address = F.concat(F.lit("https://www.example.com/news/a-"), number.cast("string"))
    head = F.concat(F.lit('<meta property="article:published_time" content="2024-01-03T1'), (number % 10).cast("string"), F.lit(':00:00Z">'))
    table = _table(spark, sf_dir, "pages")
    landed = table.select(address.alias("url"), F.when(number % 8 != 0, F.concat(head, "html")).alias("html"))
    known = table.filter(number % 3 == 0).select(address.alias("url"))
    articles = collect.site_articles(_listing_pages(spark, sf_dir), landed, SECTION, AS_OF, 24, collect.known_urls(known, SECTION))
    article = F.concat(F.lit('<div class="article-body">Content: of '), F.substring_index("url", "/", -1), F.lit("</div>"))
    bodies = items.filter(F.col("id").endswith("0")).select("url", article.alias("html"))
    return collect.collect_batch(items, channels, views.snippets(spark, sf_dir), bodies, articles)


def collect_batch(spark, sf_dir):
    batch, _ = _collected(spark, sf_dir)
    size = F.length(F.coalesce("content", F.lit(""))).alias("n_content")
    return batch.select("source_type", "id", "title", "url", "published_date", size, F.length("transcript").alias("n_transcript"))


def collect_counts(spark, sf_dir):
    return _collected(spark, sf_dir)[1]


# --- vectors, summaries, near duplicates -------------------------------------------------


def vector_parse(spark, sf_dir):
    """Vectors from JSON text, with broken texts among them."""
    number = F.col("vec_id")
    raw = (
        F.when(number % 9 == 0, F.lit("bad"))
        .when(number % 9 == 1, F.lit("[]"))
        .when(number % 9 == 2, F.lit("[[1.0]]"))
        .when(number % 9 == 3, F.lit(""))
        .otherwise(F.to_json(F.col("embedding").cast("array<double>")))
    )
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.parse_vector(raw).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(5)), 6).alias("sixth"))


def _test_vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def similar_earlier(spark, sf_dir):
    """Per vector: how many earlier ones are similar, the first of them and the best similarity."""
    yes = F.lit(True)
    rows = _test_vectors(spark, sf_dir).select(
        F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"), yes.alias("asks"), yes.alias("answers")
    )
    found = similar.earlier_neighbours(rows, SIMILAR, keep=1)
    return found.select(
        F.col("ord").alias("vec_id"),
        F.get("near", F.lit(0)).alias("first_similar"),
        F.col("found").alias("n_similar"),
        F.round("best", 6).alias("best"),
    )


def dedup_survivors(spark, sf_dir):
    return neardup.leading_rows(
        _test_vectors(spark, sf_dir), "vec_id", [F.asc("vec_id")], "embedding", SIMILAR
    ).select("vec_id")


def dedup_labels(spark, sf_dir):
    return neardup.near_dup_clusters(_test_vectors(spark, sf_dir), "vec_id", [F.asc("vec_id")], "embedding", SIMILAR)


def _clusters(spark, sf_dir, **limits):
    vectors = _test_vectors(spark, sf_dir)
    return neardup.near_dup_clusters(vectors, "vec_id", [F.asc("vec_id")], "embedding", SIMILAR, **limits)


def dedup_blocks(spark, sf_dir):
    """Clusters by way of pivots and blocks, as when vectors do not fit one block."""
    return _clusters(spark, sf_dir, block_rows=64)


def dedup_rounds(spark, sf_dir):
    """Clusters by several passes over few listed neighbours, each decided in rounds of joins."""
    return _clusters(spark, sf_dir, keep=4)


def dedup_chunks(spark, sf_dir):
    """Clusters chunk by chunk, as when vectors are more than a first chunk holds."""
    return _clusters(spark, sf_dir, first_chunk=50)


def dedup_mixed(spark, sf_dir):
    """Clusters of vectors of two lengths, some missing."""
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    mixed = F.when(F.col("vec_id") % 11 != 0, cut)
    rows = _test_vectors(spark, sf_dir).select("vec_id", mixed.alias("embedding"))
    return neardup.near_dup_clusters(rows, "vec_id", [F.asc("vec_id")], "embedding", SIMILAR, block_rows=128)


def dedup_newest(spark, sf_dir):
    """The newest of each cluster, where clusters were formed in another order."""
    rows = _test_vectors(spark, sf_dir).withColumn("created_at", views.published(F.col("vec_id")))
    order = [F.asc("vec_id")]
    clusters = neardup.near_dup_clusters(rows, "vec_id", order, "embedding", SIMILAR)
    return neardup.newest_of_clusters(rows, clusters, "vec_id", "created_at", order).select("vec_id", "created_at")


def _summaries(spark, sf_dir):
    return summarise.summarise(views.items(spark, sf_dir), AS_OF)


def summaries_default(spark, sf_dir):
    return _summaries(spark, sf_dir)


def embed_default(spark, sf_dir):
    made = embed.embed(_summaries(spark, sf_dir))
    slots = made.select("id", F.posexplode_outer("summary_vector").alias("slot", "weight"))
    return slots.filter("slot is not null").select("id", "slot", F.round("weight", 6).alias("weight"))


STORY = 0.9


def story_dedup(spark, sf_dir):
    """Stories left after near-duplicate removal on the embedded summaries, newest first."""
    made = freeze_table(embed.embed(_summaries(spark, sf_dir)), "summaries")
    newest = [F.desc("article_created_at"), F.desc("id")]
    kept = neardup.leading_rows(made, "id", newest, threshold=STORY)
    return kept.select("id", "source_id")


# --- ranking and digests -----------------------------------------------------------------


def _stored_summaries(spark, sf_dir):
    return freeze_table(_summaries(spark, sf_dir), "summaries")


def rank_topk(spark, sf_dir):
    made = _stored_summaries(spark, sf_dir)
    ranked = rank.rank_for_profiles(made, views.profiles(spark, sf_dir), AS_OF)
    return ranked.withColumn("band", rank.band(F.col("relevance_score")))


def rank_all(spark, sf_dir):
    return rank.rank_all(_summaries(spark, sf_dir), PROFILE, AS_OF)


def _records(spark, sf_dir):
    """Top-n with URLs; sources that lack a label row count as not stored."""
    known = _table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    # The label file says how large it is packed; as rows it is too many to broadcast.
    stored = views.items(spark, sf_dir).join(known.hint("merge"), "id", "left_semi")
    made, people = _stored_summaries(spark, sf_dir), views.profiles(spark, sf_dir)
    ranked = rank.rank_for_profiles(made, people, AS_OF)
    return digest.ranked_records(ranked, made, stored, people)


def enriched_topk(spark, sf_dir):
    return _records(spark, sf_dir)


def digest_rows(spark, sf_dir):
    return digest.digests(_records(spark, sf_dir), views.profiles(spark, sf_dir), AS_OF)


def _supplied(spark, sf_dir):
    """Scores as a model might give them, from the events: some out of range."""
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("profile_id"),
        F.sha2(F.concat(F.lit("rss\u0001d"), F.col("event_id").cast("string")), 256).alias("summary_id"),
        (F.col("value") / 10).alias("relevance_score"),
        (F.col("event_id") % 97).cast("int").alias("rank"),
        F.col("event_type").alias("reasoning"),
    )


def supplied_scores(spark, sf_dir):
    """Valid rows cut to ten per profile, then looked up: unknown ids leave fewer."""
    valid, _ = rank.check_scores(_supplied(spark, sf_dir))
    top = rank.top_supplied(valid)
    known = _summaries(spark, sf_dir).select(F.col("id").alias("summary_id"), "source_id")
    return top.join(known, "summary_id").select("profile_id", "summary_id", "source_id", "rank", "relevance_score", "reasoning")


def rejected_scores(spark, sf_dir):
    _, rejects = rank.check_scores(_supplied(spark, sf_dir))
    return rejects


def model_inputs(spark, sf_dir):
    """The texts handed to models: item with its whole content, embedding and record."""
    items = views.items(spark, sf_dir)
    text = summarise.item_input(F.col("title"), summarise.content_of()).alias("item_input")
    inputs = items.select("source_type", F.col("id").alias("source_id"), text)
    made = _summaries(spark, sf_dir).join(inputs, ["source_type", "source_id"])
    record = digest.record_json(
        id=F.col("id"), title=F.col("title"), source_id=F.col("source_id"), source_type=F.col("source_type"),
        summary=F.col("summary_text"), article_created_at=F.col("article_created_at"),
    )
    return made.select(
        "id",
        "item_input",
        embed.embedding_input(F.col("title"), F.col("summary_text")).alias("embedding_input"),
        record.alias("record"),
    )


def kept_answers(spark, sf_dir):
    """Answers of a model to the item titles, asked in two runs; the second finds the first's."""
    path = scratch_path(spark, "answers")
    titles = views.items(spark, sf_dir).select("id", "title")

    def model(texts):
        return texts.str.len().to_frame("size").assign(first=texts.str[:1])

    remember.answers(titles.filter("id like '%1'"), "title", path, model, "size long, first string")
    told = remember.answers(titles, "title", path, model, "size long, first string")
    return told.select("id", "answer.size", "answer.first")


def model_ranked(spark, sf_dir):
    """Candidates of each profile in the order of a model that prefers what the score ranks last."""

    def model(texts):
        lists = [[item["id"] for item in json.loads(text)["items"]][::-1] for text in texts]
        rows = [[dict(summary_id=i, relevance_score=1.0, rank=at + 1, reasoning="m") for at, i in enumerate(ids)] for ids in lists]
        return pd.DataFrame({"scores": rows})

    made = _stored_summaries(spark, sf_dir)
    people = views.profiles(spark, sf_dir)
    scores = model_rank.rank_by_model(made, people, model, scratch_path(spark, "answers"), AS_OF, candidates=20)
    valid, _ = rank.check_scores(scores)
    return rank.top_supplied(valid).select("profile_id", "summary_id", "rank")


def profile_scan(spark, sf_dir):
    """Profiles landed as JSON and read again."""
    path = scratch_path(spark, "profiles")
    views.profiles(spark, sf_dir).write.json(path)
    return profiles.read_profiles(spark, path).select(
        "profile_id", "name", F.array_join("teams", "|").alias("teams"), F.array_join("players", "|").alias("players"),
        F.array_join("interests", "|").alias("interests"), "background",
    )


def stored_summaries(spark, sf_dir):
    """Summaries appended in two runs to a table that was not there, and read by a window."""
    path = scratch_path(spark, "stored")
    store.create_table(spark, path)
    made = embed.embed(_summaries(spark, sf_dir))
    for part in ("rss", "page"):
        store.append_summaries(made.filter(F.col("source_type") == part), path)
    return store.read_summaries(spark, path, AS_OF, 24).select("id", "source_type", "source_id", "article_created_at")


def stored_digests(spark, sf_dir):
    """Digests of two days, those of the second written twice."""
    path = scratch_path(spark, "digests")
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("profile_id"), F.col("c_name").alias("body_text"))
    for day, text in (("2024-01-03", "one"), ("2024-01-04", "two"), ("2024-01-04", "three")):
        store.write_digests(rows.withColumn("body_text", F.concat("body_text", F.lit(text))).withColumn("run_date", F.lit(day).cast("date")), path)
    return spark.read.parquet(path)


def profile_texts(spark, sf_dir):
    empty = F.col("c_nationkey") == 0
    rows = _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("profile_id"),
        F.when(~empty, F.col("c_name")).alias("name"),
        F.when(~empty, F.array("c_mktsegment")).alias("interests"),
    )
    return rows.select("profile_id", profiles.profile_text("name", "interests").alias("profile"))


def run_funnel(spark, sf_dir):
    items = views.items(spark, sf_dir)
    made = freeze_table(embed.embed(summarise.summarise(items, AS_OF)), "summaries")
    twice = made.unionByName(made.withColumn("created_at", ntz("2024-01-03 00:00:00")))
    curated = daily.curate(twice, items, views.profiles(spark, sf_dir), AS_OF, 24, STORY)
    return curated.funnel()


# --- streaming ---------------------------------------------------------------------------


def stream_first_seen(spark, sf_dir):
    """Events landed twice, in two runs of the stream; each event is kept once."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "seen")
    progress = scratch_path(spark, "progress")
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for _ in range(2):
        events.write.mode("append").parquet(landing)
        stream = ingest.landed_stream(spark, landing, events.schema)
        ingest.append_stream(ingest.first_seen(stream, ["event_id"], "ts"), out, progress).awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


def stream_late(spark, sf_dir):
    """Events of the first half of each hour, then all events: repeated ones are kept once, those
    too far behind come as late."""
    landing, out, late = (scratch_path(spark, name) for name in ("landing", "seen", "late"))
    progress = scratch_path(spark, "progress")
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for part in (events.filter(F.minute("ts") < 30), events):
        part.write.mode("append").parquet(landing)
        stream = ingest.landed_stream(spark, landing, events.schema)
        ingest.first_seen_stream(stream, ["event_id"], "ts", out, late, progress).awaitTermination()
    kept, behind = spark.read.parquet(out), spark.read.schema(events.schema).parquet(late)
    rows = kept.select("event_id", "ts", F.lit(False).alias("late"))
    return rows.unionByName(behind.select("event_id", "ts", F.lit(True).alias("late")))


def stream_upsert(spark, sf_dir):
    """Items, then the batch, landed as files and merged into the item table."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "items")
    progress = scratch_path(spark, "progress")
    first = views.stored_items(spark, sf_dir).drop("created_at").withColumn("batch_pos", F.lit(0).cast("long"))
    for batch, as_of in ((first, "2024-01-03 12:00:00"), (views.upsert_batch(spark, sf_dir), AS_OF)):
        batch.select(*first.columns).write.mode("append").options(**store.PACKED).parquet(landing)
        stream = ingest.landed_stream(spark, landing, first.schema)
        ingest.upsert_stream(stream, path, progress, as_of).awaitTermination()
    return store.read_items(spark, path).select(*_ITEM_OUT)


def stream_feeds(spark, sf_dir):
    """Feeds landed in two steps and merged into the item table as they come; the entries with a
    date that does not parse are rejects."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "items")
    rejects, progress = scratch_path(spark, "rejects"), scratch_path(spark, "progress")
    entries = _rss_entries(spark, sf_dir).drop("source_type")
    late = F.col("guid._VALUE").endswith("7")
    broken = F.when(F.col("guid._VALUE").endswith("3"), F.lit("some day")).otherwise(F.col("pubDate"))
    for part in (entries.filter(~late), entries.filter(late)):
        _landed(part.withColumn("pubDate", broken), landing)
        ingest.feed_stream(ingest.rss_stream(spark, landing), path, rejects, progress, AS_OF).awaitTermination()
    taken = store.read_items(spark, path).select("id", "title", "published_date", F.lit(False).alias("rejected"))
    refused = spark.read.parquet(rejects).select("id", F.lit(True).alias("rejected"))
    return taken.unionByName(refused, allowMissingColumns=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "items_lookback": items_lookback,
    "lookback_strict": lookback_strict,
    "latest_per_key": latest_event,
    "pending_items": pending_items,
    "source_counts": source_counts,
    "transcripts": transcript_texts,
    "upsert_items": upsert_items,
    "upsert_counts": upsert_counts,
    "upsert_store": upsert_store,
    "url_normalise": url_normalise,
    "article_url_filter": article_url_filter,
    "feed_addresses": feed_addresses,
    "page_links": page_links,
    "listing_links": listing_links,
    "hostile_pages": hostile_pages,
    "linked_pages": linked_pages,
    "page_articles": page_articles_query,
    "page_titles": page_titles,
    "clean_text": clean_text,
    "rss_items": rss_items,
    "atom_items": atom_items,
    "feed_page_content": feed_page_content,
    "missing_pages": missing_pages,
    "strict_pages": strict_pages,
    "source_addresses": source_addresses,
    "collect_batch": collect_batch,
    "collect_counts": collect_counts,
    "vector_parse": vector_parse,
    "similar_earlier": similar_earlier,
    "dedup_survivors": dedup_survivors,
    "dedup_labels": dedup_labels,
    "dedup_blocks": dedup_blocks,
    "dedup_rounds": dedup_rounds,
    "dedup_chunks": dedup_chunks,
    "dedup_mixed": dedup_mixed,
    "dedup_newest": dedup_newest,
    "summaries_default": summaries_default,
    "embed_default": embed_default,
    "story_dedup": story_dedup,
    "rank_topk": rank_topk,
    "rank_all": rank_all,
    "enriched_topk": enriched_topk,
    "digest_rows": digest_rows,
    "supplied_scores": supplied_scores,
    "rejected_scores": rejected_scores,
    "model_inputs": model_inputs,
    "kept_answers": kept_answers,
    "model_ranked": model_ranked,
    "profile_scan": profile_scan,
    "stored_summaries": stored_summaries,
    "stored_digests": stored_digests,
    "profile_texts": profile_texts,
    "run_funnel": run_funnel,
    "stream_first_seen": stream_first_seen,
    "stream_late": stream_late,
    "stream_upsert": stream_upsert,
    "stream_feeds": stream_feeds,
}

"""The registered queries as SQL for another engine, to compare results with."""

from gleanery.plans.queries import BASE, SIMILAR, STORY
from gleanery.plans.views import AS_OF, BATCH_SQL, ITEMS_SQL, PROFILES_SQL, SCRIPTS_SQL

_START = f"(timestamp '{AS_OF}' - interval 24 hour)"
_SPACES = "'\\s+', ' ', 'g'"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {_SPACES}))"


def _form(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _plain(x: str) -> str:
    """Tags out, entities resolved (the closing mark may be missing), white space collapsed."""
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"regexp_replace({x}, '{entity}?', '{char}', 'g')"
    return f"trim(regexp_replace({x}, {_SPACES}))"


def _escape(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


def _url(x: str) -> str:
    host = f"regexp_extract({x}, '^[A-Za-z]+://([^/?#]*)', 1)"
    path = f"rtrim(regexp_extract({x}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')"
    return (
        f"case when {host} like '%example%' and {path} <> '' "
        f"then lower(regexp_extract({x}, '^([A-Za-z]+)://', 1)) || '://' || {host} || {path} end"
    )


def _paragraphs(x: str) -> str:
    x = f"regexp_replace({_escape(x)}, '\\n[ \\t]*\\n\\s*', '</p>' || chr(10) || '<p>', 'g')"
    return f"'<p>' || {x} || '</p>'"


_SUMMARIES = f"""{ITEMS_SQL},
told as (select *, case when source_type = 'video' then description else content end as body from items),
made as (
  select sha256(source_type || chr(1) || id) as id,
    array_to_string(list_slice(string_split({_clean("title")}, ' '), 1, 10), ' ') as title,
    id as source_id, source_type,
    array_to_string(list_transform(list_sort(list_transform(list_slice(list_sort(list_transform(
      string_split(regexp_replace({_clean("body")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)),
      lambda s, i: {{'score': -2 * len(list_distinct(list_intersect(string_split(lower({_clean("title")}), ' '), string_split(lower(s), ' '))))
        - least(len(string_split(lower(s), ' ')), 25), 'place': i, 'text': s}})), 1, 3),
      lambda b: {{'place': b.place, 'text': b.text}})), lambda b: b.text), ' ') as summary_text,
    published_date as article_created_at, timestamp '{AS_OF}' as created_at
  from told)"""

_EMBEDDED = f"""{_SUMMARIES},
words as (
  select id, unnest(list_filter(regexp_split_to_array(
    lower('Title: ' || title || chr(10) || 'Summary: ' || summary_text), '\\s+'), lambda x: x <> '')) as w
  from made where summary_text <> ''),
counted as (select id, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as slot, count(*) as n from words group by 1, 2),
full_ as (
  select m.id, s.slot, coalesce(c.n, 0) as n
  from (select id from made where summary_text <> '') m cross join (select range as slot from range(64)) s
  left join counted c on c.id = m.id and c.slot = s.slot),
vecs as (
  select id, list(n::double / norm order by slot) as e from (
    select id, slot, n, sqrt(sum(n * n) over (partition by id)) as norm from full_) group by id)"""


def _greedy(vectors: str, threshold: float) -> str:
    """Greedy leaders over ``vectors`` (i from 0, key, e); ends with g(i, kept)."""
    return f"""v as materialized ({vectors}),
e as materialized (
  select a.i as i, b.i as j from v a join v b on b.i < a.i and list_cosine_similarity(a.e, b.e) >= {threshold} - 1e-9),
adj as materialized (
  select v.i, list(e.j) filter (e.j is not null) as ns from v left join e using (i) group by v.i),
g(i, kept) as (
  select -1::bigint, []::bigint[]
  union all
  select g.i + 1, case when list_has_any(coalesce(adj.ns, []::bigint[]), g.kept) then g.kept
    else list_append(g.kept, g.i + 1) end
  from g join adj on adj.i = g.i + 1),
kept as materialized (select unnest(kept) as i from (select kept from g order by i desc limit 1))"""


_TEST_VECTORS = (
    "select row_number() over (order by vec_id) - 1 as i, vec_id, embedding::double[] as e from embeddings"
)
_LABELS = f"""with recursive {_greedy(_TEST_VECTORS, SIMILAR)},
placed as (
  select v.i, v.vec_id, coalesce(min(k.i), v.i) as lead
  from v left join e on e.i = v.i left join kept k on k.i = e.j and v.i not in (select i from kept)
  group by v.i, v.vec_id)"""

_CLUSTERED = f"{_LABELS} select p.vec_id, l.vec_id as leader from placed p join v l on l.i = p.lead"
# Vectors of two lengths, some missing: only equal lengths are compared.
_MIXED = _CLUSTERED.replace(
    "embedding::double[] as e from embeddings",
    "case when vec_id % 11 = 0 then null when vec_id % 5 = 0 then embedding[1:32]::double[] "
    "else embedding::double[] end as e from embeddings",
).replace(
    "list_cosine_similarity(a.e, b.e) >=", "case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) end >="
)

_SCORED = f"""{_SUMMARIES}, {PROFILES_SQL},
forms as (
  select *, ' ' || {_form("title || ' ' || summary_text")} || ' ' as f,
    round(2 * greatest(0, 1 - date_diff('second', article_created_at, timestamp '{AS_OF}') / 3600.0 / 24), 4) as fresh
  from made),
scored as (
  select p.profile_id, m.id, m.article_created_at,
    round(least(10,
      3 * least(2, len(list_filter(list_distinct(p.teams), lambda w: contains(m.f, ' ' || w || ' ')))) +
      2.5 * least(2, len(list_filter(p.players, lambda w: contains(m.f, ' ' || w || ' ')))) +
      least(3, len(list_filter(p.interests, lambda w: contains(m.f, ' ' || w || ' ')))) + m.fresh), 4)::double as relevance_score
  from profiles p cross join forms m),
ranked as (
  select * exclude (rank), rank::int as rank from (select *, row_number() over (
    partition by profile_id order by relevance_score desc, article_created_at desc, id) as rank from scored)
  where rank <= 10)"""

_RECORDS = f"""{_SCORED},
stored as (select source_type, id, url from items where doc_id in (select doc_id from labels)),
found as (
  select r.profile_id, m.id, m.title, m.summary_text as summary, coalesce(s.url, '') as url, m.source_id,
    m.source_type, m.article_created_at, r.rank, r.relevance_score,
    list_sort(list_concat(
      list_transform(list_filter(p.interests, lambda w: contains(m.f, ' ' || w || ' ')), lambda w: 'i:' || w),
      list_transform(list_filter(p.players, lambda w: contains(m.f, ' ' || w || ' ')), lambda w: 'p:' || w),
      list_transform(list_filter(list_distinct(p.teams), lambda w: contains(m.f, ' ' || w || ' ')), lambda w: 't:' || w))) as hits
  from ranked r join forms m on m.id = r.id join profiles p on p.profile_id = r.profile_id
  left join stored s on s.source_type = m.source_type and s.id = m.source_id),
records as (
  select * exclude (hits), case when len(hits) > 0
    then 'Mentions: ' || array_to_string(list_transform(hits, lambda h: substr(h, 3)), ', ')
    else 'No stated interest' end as reasoning
  from found)"""

_LABEL = f"strftime(timestamp '{AS_OF}', '%B %d, %Y')"
_INTRO = """'Today''s digest has ' || n_items || case when n_items = 1 then ' story' else ' stories' end
    || '. It opens with: ' || array_to_string(titles[1:3], '; ') || '.'"""

_MERGED = f"""{ITEMS_SQL}, {BATCH_SQL},
last_ as (
  select * from (select *, row_number() over (partition by source_type, id order by batch_pos desc) as n from batch)
  where n = 1),
merged as (
  select coalesce(l.source_type, i.source_type) as source_type, coalesce(l.id, i.id) as id,
    coalesce(l.title, i.title) as title, coalesce(l.description, i.description) as description,
    coalesce(l.url, i.url) as url, coalesce(l.published_date, i.published_date) as published_date,
    coalesce(l.content, i.content) as content,
    case when i.id is not null then timestamp '2024-01-03 12:00:00' else timestamp '{AS_OF}' end as created_at
  from items i full outer join last_ l on l.source_type = i.source_type and l.id = i.id)"""

_PENDING = f"""{ITEMS_SQL}, {SCRIPTS_SQL},
open_ as (
  select i.* from items i
  where published_date >= timestamp '{AS_OF}' - interval 72 hour
    and (source_type <> 'video' or exists (select 1 from scripts s where s.id = i.id and s.transcript is not null))
    and not exists (select 1 from labels l where l.doc_id = i.doc_id))"""

_HREFS = r"""'<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"'"""
_BARE = r"""regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"""

_ISO = "(timestamp '2024-01-01 10:00:00' + to_days((page_id % 28)::int) + to_minutes((page_id % 60)::int))"
_WRITTEN = "(timestamp '2024-01-01 21:00:00' + to_days((page_id % 28)::int) + to_minutes((page_id % 60)::int))"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"

_SUPPLIED = """supplied as (
  select 'u' || user_id as profile_id, sha256('rss' || chr(1) || 'd' || event_id) as summary_id,
    value / 10 as relevance_score, (event_id % 97)::int as rank, event_type as reasoning
  from events)"""
_VALID = "coalesce(relevance_score between 0 and 10 and rank >= 1 and profile_id is not null and reasoning is not null, false)"

_COLLECTED = f"""{ITEMS_SQL}, {SCRIPTS_SQL},
feed as (
  select 'rss' as source_type, id, {_clean("title")} as title, url, published_date + to_hours([0, 0, 5, 5, 4][1 + doc_id % 5]) as published_date,
    case when doc_id % 10 = 0 then length('of ' || doc_id) else 0 end as n_content, null::int as n_transcript
  from items where source_type = 'rss'),
clips as (
  select 'video' as source_type, i.id, {_clean("title")} as title, 'https://v.example.com/watch?v=' || i.id as url, published_date,
    0 as n_content, length(s.transcript)::int as n_transcript
  from items i left join scripts s on s.id = i.id where doc_id % 4 <> 0),
section as (
  select 'page' as source_type, 'a-' || page_id as id, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as title,
    '{BASE}/news/a-' || page_id as url, timestamp '2024-01-03 10:00:00' + to_hours((page_id % 10)::int) as published_date,
    length(array_to_string(list_filter(list_transform(
      string_split(replace(replace({_ARTICLE}, '<p>', chr(1)), '</p>', chr(1)), chr(1))[2:],
      lambda x: {_plain("x")}), lambda x: x <> ''), chr(10) || chr(10))) as n_content, null::int as n_transcript
  from pages where page_id % 4 = 0 and page_id % 8 <> 0 and page_id % 3 <> 0),
collected as (
  select * from feed where published_date > {_START} union all select * from clips where published_date > {_START}
  union all select * from section where title <> '')"""

ORACLE: dict[str, str] = {
    "items_lookback": f"with {ITEMS_SQL} select source_type, id, title, published_date from items where published_date >= {_START}",
    "lookback_strict": f"""with {ITEMS_SQL} select source_type, id, published_date from items
        where published_date > timestamp '2024-01-03 01:37:00'""",
    "latest_per_key": """select event_type, user_id, event_id, ts, value from (
        select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as n from events)
        where n = 1""",
    "pending_items": f"with {_PENDING} select source_type, id, published_date from open_",
    "source_counts": f"""with {_PENDING} select s.source_type, count(o.id) as items
        from (values ('page'), ('rss'), ('video'), ('radio')) s(source_type)
        left join open_ o on o.source_type = s.source_type group by s.source_type""",
    "transcripts": f"with {SCRIPTS_SQL} select id, transcript from scripts",
    "upsert_items": f"with {_MERGED} select * from merged",
    "upsert_counts": f"""with {ITEMS_SQL}, {BATCH_SQL},
        copies as (select source_type, id, count(*) as n from batch group by 1, 2)
        select c.source_type, count(*) filter (i.id is null) as inserted,
          sum(c.n)::bigint - count(*) filter (i.id is null) as updated
        from copies c left join items i on i.source_type = c.source_type and i.id = c.id group by c.source_type""",
    "upsert_store": f"with {_MERGED} select * from merged where published_date >= {_START}",
    "url_normalise": f"select page_id, {_url('url')} as url from pages",
    "article_url_filter": f"""with n as (select page_id, {_url("url")} as url from pages),
        p as (select page_id, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) as path from n where url is not null),
        q as (select page_id, path, regexp_extract(path, '([^/]*)$', 1) as slug from p)
        select page_id, slug as article_id from q
        where path like '/en/%' and slug not in ('', 'en', '7') and path not like '/en/1%' and path not like '/en/20%'""",
    "feed_addresses": """select page_id,
        'https://feeds.example.com/videos.xml?channel_id=' || regexp_extract(url, '([^/]*)$', 1) as feed from pages""",
    "page_links": f"""with h as (select url as page_url, regexp_extract_all({_BARE}, {_HREFS}, 1) as hrefs from pages),
        r as (select page_url, list_filter(list_transform(hrefs, lambda u: rtrim(regexp_replace(u, '[?#].*$', ''), '/')),
          lambda u: u like '/%' and regexp_extract(u, '([^/]*)$', 1) not in ('', 'news', 'home') and u not like '/a%') as us from h)
        select page_url, (i - 1)::int as pos, '{BASE}' || us[i] as url from (
          select page_url, us, unnest(range(1, len(us) + 1)) as i from r)""",
    "listing_links": f"""with p as (select url as page_url, page_id, page_id % 4 as kind from pages),
        u as (
          select page_url, unnest(case
            when kind = 0 then ['list-' || page_id, 'a-' || page_id, 'a-' || page_id, 'b-' || page_id]
            when kind = 1 then ['s-' || page_id, 't']
            else ['anchor-' || page_id] end) as slug,
            unnest(case when kind = 0 then [0, 1, 2, 3] when kind = 1 then [0, 1] else [0] end)::int as pos from p)
        select page_url, pos, '{BASE}/news/' || slug as url from u""",
    "hostile_pages": f"""with u as (
          select url as page_url, unnest(case when page_id % 3 = 1 then ['half' || chr(65533) || '-' || page_id]
              else ['quoted-' || page_id, 'tight-' || page_id, 'caf' || chr(233) || '-' || page_id || '-x'] end) as slug,
            unnest(case when page_id % 3 = 1 then [0] else [0, 1, 2] end)::int as pos
          from pages)
        select page_url, pos, '{BASE}/news/' || slug as url from u""",
    "linked_pages": f"""select '{BASE}/news/a-' || (page_id + 2) as url, len(html)::int as n_chars from pages
        where (page_id + 2) % 4 = 0 and page_id + 2 in (select page_id from pages)""",
    "page_articles": f"""with p as (
          select *, page_id % 7 as kind, {_url("url")} as link, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as h1,
            list_filter(list_transform(
              string_split(replace(replace({_ARTICLE}, '<p>', chr(1)), '</p>', chr(1)), chr(1))[2:],
              lambda x: {_plain("x")}), lambda x: x <> '') as blocks
          from pages),
        a as (
          select regexp_extract(link, '([^/]*)$', 1) as id, link as url,
            case kind when 0 then 'Head ' || page_id when 2 then 'Tw & ' || page_id else h1 end as title,
            case kind when 2 then 'About ' || page_id else '' end as description,
            case kind when 0 then {_ISO} - interval 2 hour + interval 500 millisecond when 1 then {_ISO}
              when 3 then {_ISO} + interval 330 minute when 6 then null else {_WRITTEN} end as published_date,
            array_to_string(blocks, chr(10) || chr(10)) as content
          from p where link is not null)
        select * from a where title <> '' and published_date >= timestamp '2024-01-11 10:00:00'""",
    "page_titles": f"select url, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as title from pages",
    "clean_text": f"select doc_id, {_clean('text')} as text from documents",
    "rss_items": f"""with {ITEMS_SQL}, f as (
          select 'rss' as source_type, id, {_clean("title")} as title, {_clean("description")} as description, url,
            published_date + to_hours([0, 0, 5, 5, 4][1 + doc_id % 5]) as published_date from items)
        select * from f where published_date > {_START}""",
    "atom_items": f"""with {ITEMS_SQL}
        select 'video' as source_type, id, {_clean("title")} as title, {_clean("description")} as description,
          'https://v.example.com/watch?v=' || id as url, published_date
        from items where doc_id % 4 <> 0 and published_date > {_START}""",
    "feed_page_content": """select 'e' || page_id as id, url, case page_id % 3
          when 0 then 'Body of ' || page_id || ' & Content: more' when 1 then 'Only ' || page_id else '' end as content
        from pages union all select 'x' || page_id, url || '&gone', '' from pages""",
    "vector_parse": """select vec_id, case when vec_id % 9 < 4 then null else len(embedding) end::int as n,
        case when vec_id % 9 < 4 then null else round(embedding[6]::double, 6) end as sixth from embeddings""",
    "similar_earlier": f"""with v as materialized (select vec_id, embedding::double[] as e from embeddings)
        select a.vec_id, min(b.vec_id) as first_similar, count(*) as n_similar,
          round(max(list_cosine_similarity(a.e, b.e)), 6) as best
        from v a join v b on b.vec_id < a.vec_id and list_cosine_similarity(a.e, b.e) >= {SIMILAR} - 1e-9 group by a.vec_id""",
    "dedup_survivors": f"with recursive {_greedy(_TEST_VECTORS, SIMILAR)} select vec_id from v where i in (select i from kept)",
    "dedup_labels": _CLUSTERED,
    "dedup_blocks": _CLUSTERED,
    "dedup_rounds": _CLUSTERED,
    "dedup_chunks": _CLUSTERED,
    "dedup_mixed": _MIXED,
    "dedup_newest": f"""{_LABELS},
        aged as (select *, timestamp '2024-01-01 00:00:00' + to_minutes((vec_id * 97) % 4320) as created_at from placed)
        select vec_id, created_at from (
          select *, row_number() over (partition by lead order by created_at desc, i) as n from aged) where n = 1""",
    "summaries_default": f"with {_SUMMARIES} select * from made",
    "embed_default": f"""with {_EMBEDDED}
        select id, (i - 1)::int as slot, round(e[i], 6) as weight from (
          select id, e, unnest(range(1, 65)) as i from vecs)""",
    "story_dedup": f"""with recursive {_EMBEDDED},
        {_greedy('''select row_number() over (order by m.article_created_at desc, m.id desc) - 1 as i, m.id, m.source_id, e
          from made m join vecs on vecs.id = m.id''', STORY)}
        select id, source_id from v where i in (select i from kept)
        union all select id, source_id from made where summary_text = ''""",
    "rank_topk": f"""with {_SCORED} select profile_id, id, rank, relevance_score, case
          when relevance_score >= 9 then 'high' when relevance_score >= 7 then 'very relevant'
          when relevance_score >= 5 then 'moderate' when relevance_score >= 3 then 'some' else 'low' end as band
        from ranked""",
    "rank_all": f"""with {_SCORED},
        one as (
          select id, article_created_at, list_filter(['i:that', 'p:of the', 't:des', 't:the'],
            lambda w: contains(f, ' ' || substr(w, 3) || ' ')) as hits, fresh from forms),
        points as (
          select id, article_created_at, hits, round(least(10, 3 * len(list_filter(hits, lambda h: h like 't:%'))
            + 2.5 * len(list_filter(hits, lambda h: h like 'p:%')) + len(list_filter(hits, lambda h: h like 'i:%')) + fresh), 4)::double
            as relevance_score from one)
        select id, (row_number() over (order by relevance_score desc, article_created_at desc, id))::int as rank,
          relevance_score, case when len(hits) > 0
            then 'Mentions: ' || array_to_string(list_transform(hits, lambda h: substr(h, 3)), ', ')
            else 'No stated interest' end as reasoning from points""",
    "enriched_topk": f"with {_RECORDS} select * from records",
    "digest_rows": f"""with {_RECORDS},
        shown as (
          select profile_id, count(*)::int as n_items, list(title order by rank) as titles,
            string_agg(rank || '. ' || title || chr(10) || trim(summary)
              || case when url <> '' then chr(10) || 'Read more: ' || url else '' end || chr(10), chr(10) order by rank) as texts,
            string_agg('<section>' || chr(10) || '<h3>' || rank || '. ' || {_escape("title")} || '</h3>' || chr(10)
              || {_paragraphs("trim(summary)")} || case when url <> ''
                then chr(10) || '<p><a href="' || {_escape("url")} || '">Read more</a></p>' else '' end
              || chr(10) || '</section>', chr(10) || '<hr>' || chr(10) order by rank) as htmls
          from records group by profile_id),
        named as (
          select s.*, 'Hi ' || coalesce(p.name, 'there') || ' - happy ' || {_LABEL} || '!' as hello, {_INTRO} as opening,
            'Top ' || n_items || ' News Articles for ' || {_LABEL} as top
          from shown s left join profiles p on p.profile_id = s.profile_id)
        select profile_id, date '2024-01-04' as run_date, n_items, 'News Daily Summary - ' || {_LABEL} as subject,
          rtrim('News Daily Summary' || chr(10) || chr(10) || hello || chr(10) || opening || chr(10) || chr(10) || top
            || chr(10) || chr(10) || texts, chr(10)) as body_text,
          '<h1>News Daily Summary</h1>' || chr(10) || {_paragraphs("hello")} || chr(10) || {_paragraphs("opening")}
            || chr(10) || '<h2>' || {_escape("top")} || '</h2>' || chr(10) || '<hr>' || chr(10) || htmls as body_html
        from named""",
    "supplied_scores": f"""with {_SUMMARIES}, {_SUPPLIED},
        top as (select *, row_number() over (partition by profile_id order by rank, summary_id) as n from supplied where {_VALID})
        select t.profile_id, t.summary_id, m.source_id, t.rank, t.relevance_score, t.reasoning
        from top t join made m on m.id = t.summary_id where t.n <= 10""",
    "rejected_scores": f"with {_SUPPLIED} select * from supplied where not {_VALID}",
    "model_inputs": f"""with {_SUMMARIES} select made.id,
          'Summarise this ' || case when made.source_type = 'video' then 'video' else 'article' end || '.' || chr(10) || chr(10)
            || 'Title: ' || told.title || chr(10) || chr(10) || 'Content:' || chr(10) || coalesce(told.body, '') as item_input,
          case when summary_text <> '' then 'Title: ' || made.title || chr(10) || 'Summary: ' || summary_text end as embedding_input,
          to_json({{'id': made.id, 'title': made.title, 'source_id': source_id, 'source_type': made.source_type, 'summary': summary_text,
            'article_created_at': strftime(article_created_at, '%Y-%m-%dT%H:%M:%S')}})::varchar as record
        from made join told on told.id = made.source_id and told.source_type = made.source_type""",
    "profile_texts": """select 'c' || c_custkey as profile_id, case when c_nationkey = 0
          then 'No reader profile is given. Rank by general news importance.'
          else to_json({'name': c_name, 'interests': [c_mktsegment]})::varchar end as profile from customer""",
    "run_funnel": f"""with recursive {_EMBEDDED},
        recent as (select * from made where article_created_at >= {_START}),
        {_greedy('''select row_number() over (order by m.id desc) - 1 as i, m.id, e
          from recent m join vecs on vecs.id = m.id''', STORY)},
        left_ as (
          select (select count(*) from kept) + (select count(*) from recent where summary_text = '') as n)
        select 'loaded' as step, 1 as position, (select 2 * count(*) from recent) as n_rows
        union all select 'latest', 2, (select count(*) from recent)
        union all select 'unclustered', 3, (select n from left_)
        union all select 'ranked', 4, (select count(*) from customer) * (select least(10, n) from left_)
        union all select 'top', 5, (select count(*) from customer) * (select least(10, n) from left_)""",
    "missing_pages": """select 'e' || page_id as id, url, case when page_id % 5 = 0 then ''
          when page_id % 7 = 0 then page_id || ' and more' else page_id || '' end as content from pages""",
    "strict_pages": "select url, length(html)::int as n_chars from pages",
    "source_addresses": """select case when page_id % 2 = 0 then 'video' else 'rss' end as source_type, url as address,
        case when page_id % 2 = 0 then 'https://feeds.example.com/videos.xml?channel_id=' || regexp_extract(url, '([^/]*)$', 1)
          else url end as landed_from from pages""",
    "collect_batch": f"with {_COLLECTED} select * from collected",
    "collect_counts": f"""with {_COLLECTED} select s.source_type, count(c.id) as items
        from (values ('page'), ('rss'), ('video')) s(source_type) left join collected c on c.source_type = s.source_type
        group by s.source_type""",
    "kept_answers": f"with {ITEMS_SQL} select id, length(title) as size, title[1:1] as first from items",
    "model_ranked": f"""with {_SCORED.replace("where rank <= 10", "where rank <= 20")},
        turned as (select profile_id, id as summary_id, row_number() over (partition by profile_id order by rank desc) as rank from ranked)
        select profile_id, summary_id, rank::int as rank from turned where rank <= 10""",
    "profile_scan": f"""with {PROFILES_SQL} select profile_id, name, array_to_string(teams, '|') as teams,
        array_to_string(players, '|') as players, array_to_string(interests, '|') as interests, null::varchar as background from profiles""",
    "stored_summaries": f"""with {_SUMMARIES} select id, source_type, source_id, article_created_at from made
        where source_type in ('rss', 'page') and article_created_at >= {_START}""",
    "stored_digests": """select 'c' || c_custkey as profile_id, c_name || t.text as body_text, t.day as run_date
        from customer, (values (date '2024-01-03', 'one'), (date '2024-01-04', 'three')) t(day, text)""",
    "stream_feeds": f"""with {ITEMS_SQL}, f as (
          select id, {_clean("title")} as title, published_date + to_hours([0, 0, 5, 5, 4][1 + doc_id % 5]) as published_date,
            doc_id % 10 = 3 as broken from items)
        select id, title, published_date, false as rejected from f where not broken and published_date > {_START}
        union all select id, null, null, true from f where broken""",
    "stream_late": """with b as (select max(ts) - interval 24 hour as bound from events where extract(minute from ts) < 30)
        select event_id, ts, false as late from events, b where extract(minute from ts) < 30 or ts >= bound
        union all select event_id, ts, true from events, b where ts < bound""",
    "stream_first_seen": "select event_id, ts, user_id, event_type, value from events",
    "stream_upsert": f"with {_MERGED} select * from merged",
}

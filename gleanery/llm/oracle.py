"""The queries of this package as DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from gleanery.llm import sharding

_WHITE = r"[\x20\x09-\x0D]"
_INK = r"[^\x20\x09-\x0D]"

# Every pair of documents that share a word run, counted.
OP1 = rf"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_INK}+') as w
  from documents),
u as (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as pos from d where len(w) > 0),
s as materialized (select distinct doc_id, array_to_string(w[pos:pos + 3], ' ') as run from u),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as hits
  from s a join s b on a.run = b.run and a.doc_id < b.doc_id group by 1, 2),
e as materialized (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * hits >= 80 * (x.n + y.n - hits)),
edges2 as materialized (select a, b from e union all select b, a from e),
r(doc_id, other) as (
  select doc_id, doc_id from d union select r.doc_id, b from r join edges2 on other = a),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, component_id = c.doc_id as kept
from c left join n on c.doc_id = n.doc_id"""

OP2 = rf"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*)::bigint as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
from t join g using (norm)"""

OP4 = rf"""
with d as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_INK}+'))::bigint as size,
    md5('mix-1:' || doc_id::varchar) as dg
  from documents),
s as (
  select source, sum(size)::bigint as held,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w
  from d group by source),
p as (
  select *, 3 * sum(held) over () - 2 * coalesce(sum(2 * held) over (order by held::double / w, source
      rows between unbounded preceding and 1 preceding), 0) as rest2,
    sum(w) over (order by held::double / w, source rows between current row and unbounded following) as open_w
  from s),
f as (select *, w * rest2 >= 4 * held * open_w as is_full from p),
share as (
  select any_value(rest2) as rest2, any_value(open_w) as open_w from (
    select rest2, open_w from f where not is_full order by held::double / w, source limit 1)),
t as (
  select f.source, f.held, case when is_full then (2 * held)::double
    else (f.w * share.rest2)::double / (2 * share.open_w)::double end as target
  from f, share),
q as (select *, floor(target + 0.5)::bigint as quota from t),
o as (
  select d.doc_id, d.source, d.size, d.dg, q.held, q.target, q.quota,
    sum(d.size) over (partition by d.source order by d.dg, d.size, d.doc_id) as e
  from d join q on d.source is not distinct from q.source),
k as (
  select o.*, r.k, least(held, quota - r.k * held) as high
  from o, (values (0), (1)) r(k) where size > 0 and quota - r.k * held > 0),
i as (select *, e <= high as inside from k),
gap as (
  select source, k, max(high) - coalesce(sum(size) filter (inside), 0) as gap from i group by source, k),
fill as (
  select i.doc_id, i.k, row_number() over (partition by i.source, i.k
    order by abs(gap - i.size), i.dg, i.size, i.doc_id) as n
  from i join gap on i.source is not distinct from gap.source and i.k = gap.k
  where not inside and gap > 0 and abs(gap - i.size) < gap),
c as (
  select doc_id, count(*) as copies from (
    select doc_id, k from i where inside union all select doc_id, k from fill where n = 1)
  group by doc_id)
select o.doc_id, o.size, o.held as source_size, o.target, (o.size * coalesce(c.copies, 0))::bigint as taken
from o left join c on o.doc_id = c.doc_id"""

# The list functions keep the work per document; nothing is joined.
OP8 = rf"""
with t as materialized (
  select doc_id, coalesce(text, '') as x,
    regexp_extract_all(coalesce(text, ''), '{_INK}+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_INK}')) as lines
  from documents),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from t where len(w) >= 5),
l as (
  select doc_id, pos, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' ||
    lead(word, 3) over p || ' ' || lead(word, 4) over p as run
  from u window p as (partition by doc_id order by pos)),
v as (select doc_id, pos, count(*) over (partition by doc_id, run) as n from l where run is not null),
r as (
  select doc_id, sum(least(5, coalesce(later, pos + 5) - pos)) as n_repeat from (
    select doc_id, pos, lead(pos) over (partition by doc_id order by pos) as later from v where n > 1)
  group by doc_id),
m as (
  select t.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(x, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    len(regexp_extract_all(x, '!')) as n_marks
  from t left join r on t.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 40 * n_words
    or 100 * n_marks > 50 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 100 * n_dup_lines > 50 * n_lines) as kept
from m"""

# Without a function for SHA-1 in older versions, the twin needs DuckDB with sha1().
OP9 = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
g as (select html, max(page_id) as kept from p where payload_bytes >= 1000 group by html)
select page_id, payload_bytes, sha1(p.html) as payload_digest,
  case when kept is not null and page_id is distinct from kept then 'revisit' else 'response' end as record_type,
  case when kept is not null and page_id is distinct from kept then kept end as refers_to
from p left join g on p.html = g.html"""

# Checksums bit by bit from the fixed polynomial of CRC-32, reflected.
_CRC_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"


def _op10() -> str:
    keys = ", ".join(str(k) for k in sharding.round_keys())
    mixed = f"(((r * {sharding.FIRST}::ubigint + k::ubigint) & 4294967295)::ubigint)"
    second = f"((xor({mixed}, {mixed} >> 15) * {sharding.SECOND}::ubigint) & 4294967295)::ubigint"
    return f"""
with recursive bits(v, c, n) as (
  select v, v::ubigint, 0 from range(256) t(v)
  union all
  select v, {_CRC_STEP}, n + 1 from bits where n < 8),
crc_table as (select list(c order by v) as crc from bits where n = 8),
d as materialized (
  select doc_id, strlen(coalesce(text, ''))::bigint + 16 as size,
    xor(list_reduce(
      list_prepend(4294967295::ubigint, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::ubigint)),
      lambda a, b: xor(a >> 8, crc[((xor(a, b) & 255) + 1)::bigint])), 4294967295::ubigint)::bigint as text_crc32
  from documents, crc_table),
n as materialized (
  select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as number, count(*) over () as total
  from d),
h as (select max(greatest(1, (length(bin(greatest(1, total - 1))) + 1) // 2)) as half from n),
walk(number, l, r, step, done) as (
  select number, (number >> half)::ubigint, (number & ((1 << half) - 1))::ubigint, 0, false from n, h
  union all
  select number, r, xor(l, (xor({second}, {second} >> 13) & ((1 << half) - 1)::ubigint)), step + 1,
    (step + 1) % {sharding.ROUNDS} = 0 and
      (r << half) + xor(l, (xor({second}, {second} >> 13) & ((1 << half) - 1)::ubigint)) < total
  from (
    select walk.*, half, [{keys}][(step % {sharding.ROUNDS}) + 1] as k, (select max(total) from n) as total
    from walk, h where not done)),
p as (select number, ((l << half) + r)::bigint as position from walk, h where done)
select doc_id, size, text_crc32, 'rows' as law, (position % {sharding.SHARDS})::int as shard,
  (position // {sharding.SHARDS})::bigint as slot, null::int as grown_shard
from n join p using (number)"""


# Every order and step, counted from the cells of failed filters.
OP11 = rf"""
with t as materialized (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x from documents),
u as (select x, min(doc_id) as earliest from t group by x),
l as (
  select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic
  from labels group by doc_id),
w as (select t.*, regexp_extract_all(x, '{_INK}+') as w, earliest from t join u using (x)),
m as materialized (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x))::int
    + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > earliest, false)::int as mask
  from w left join l on w.doc_id = l.doc_id),
c as materialized (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, mask),
f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from o, (values (1), (2), (3), (4), (5)) v(step)),
r as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as toxic_lost
  from c, s group by part, filter_order, step, bit)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from r"""

# Windows of every length that occurs, joined as texts.
_RUNS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP13_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    f"'{_RUNS}')"
)
OP13 = f"""
with d as materialized (select row_number() over () as r, doc_id, {_OP13_WORDS} as w from documents),
b as (select item_id, {_OP13_WORDS} as w from benchmark),
v as (
  select item_id, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p
  from b where len(w) > 0),
bw as materialized (select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as run from v),
dw as (
  select r, size, w, unnest(range(1, len(w) - size + 2)) as p
  from d, (select distinct size from bw) where len(w) >= size),
h as materialized (
  select r, p, dw.size, item_id from dw join bw on dw.size = bw.size and array_to_string(w[p:p + dw.size - 1], ' ') = run),
n as (select r, count(*) as n_hit from (select distinct r, unnest(range(p, p + size)) as at from h) group by r),
i as (
  select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct r, item_id::varchar as id from h where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.r = n.r left join i on d.r = i.r"""


ORACLE: dict[str, str] = {
    "op1_minhash_dedup": OP1,
    "op2_exact_dedup": OP2,
    "op4_mixing": OP4,
    "op8_quality_rules": OP8,
    "op9_warc": OP9,
    "op10_sharding": _op10(),
    "op11_filter_audit": OP11,
    "op13_decontamination": OP13,
}

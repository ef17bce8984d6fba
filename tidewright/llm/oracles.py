"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

ORACLES = {
    "op1_warc": """
with p as (
  select page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) s from pages),
g as (select h, max(page_id) last from p where n >= 1000 group by h)
select p.page_id, p.n::bigint as payload_bytes, p.s as payload_digest,
  case when p.page_id < g.last then 'revisit' else 'response' end as record_type,
  case when p.page_id < g.last then g.last end as refers_to
from p left join g on p.n >= 1000 and p.h = g.h""",
    "op9_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
p as (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) c from p),
r as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from g where c >= 2) group by doc_id),
c as (
  select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines,
    len(list_filter(ws, lambda x: lower(x) in ({_STOPS})))::bigint n_stop_words
  from w left join r on w.doc_id = r.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from c)
select *, not base_failed and word_chars between 1.5 * n_words and 25 * n_words and n_symbols <= 0.3 * n_words
  and n_stop_words >= 0.005 * n_words and n_dup_lines <= 0.7 * n_lines as kept
from b""",
    "op7_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
k as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
m as (select g, min(doc_id) as m from k group by g),
x as (select distinct doc_id, unnest(range(i, i + 50)) as j from k join m using (g) where m < doc_id),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
r as (select p.doc_id, count(x.j) as n_removed, string_agg(p.word, ' ' order by p.j) filter (x.j is null) as kept from p left join x on x.doc_id = p.doc_id and x.j = p.j group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join r on r.doc_id = w.doc_id""",
    "op8_minhash": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.node)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept
from documents d join r on r.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
    "op11_filter_audit": r"""
with m as (select coalesce(text, '') t, min(doc_id) first from documents group by 1),
f as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
b as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
    + 4 * (100 * (length(f.t) - length(regexp_replace(f.t, '[A-Z]', '', 'g'))) > 2 * length(f.t))::int
    + 8 * regexp_matches(f.t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int bits
  from f join m on m.t = f.t left join l using (doc_id)),
c as (select part, bits, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from b group by 1, 2),
v(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p as (
  select [a.bit, b.bit, c.bit, d.bit, e.bit] bs, a.letter || b.letter || c.letter || d.letter || e.letter filter_order
  from v a join v b on b.bit <> a.bit join v c on c.bit not in (a.bit, b.bit) join v d on d.bit not in (a.bit, b.bit, c.bit)
  join v e on a.bit + b.bit + c.bit + d.bit + e.bit = 31 and e.bit not in (a.bit, b.bit, c.bit, d.bit)),
s as (select filter_order, step, bs[step] bit, list_sum(bs[1:step]) - bs[step] before from p, range(1, 6) t(step)),
o as (
  select part, filter_order, step::int step, bit, sum(n) filter (bits & (before + bit) = 0) kept,
    sum(n) filter (bits & before = 0 and bits & bit > 0) removed, sum(n) filter (bits & before > 0 and bits & bit > 0) redundant,
    sum(n) filter (bits = bit) unique_fails, sum(g) filter (bits & before = 0 and bits & bit > 0) good_lost,
    sum(x) filter (bits & before = 0 and bits & bit > 0) toxic_lost
  from c, (select filter_order, step, bit, before::bigint before from s) group by 1, 2, 3, 4)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant,
  coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
  coalesce(sum(removed) over (partition by part, bit), 0)::bigint shapley
from o""",
    "op12_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) pos from documents),
k as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key
  from l),
c as (select key, max(doc_id) last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, coalesce(c.last <> doc_id, false) gone from k left join c using (key))
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from j group by doc_id""",
}

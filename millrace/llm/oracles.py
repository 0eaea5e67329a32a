"""SQL for DuckDB that gives the same rows as some of the queries, by plainer means.

Recursive parts walk links to the least reachable id; all of it is meant for
small tables, the operators are what scales.
"""

from __future__ import annotations

#: op1: every 100-byte string of every document; a start is repeated if an equal one starts earlier.
SUBSTRINGS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, i, substr(h, 2 * i + 1, 200) as w from (select doc_id, h, unnest(range(0, n - 99)) as i from d where n >= 100) t),
r as (select doc_id, i, w, row_number() over (partition by w order by doc_id, i) as k from s),
g as (select doc_id, i, case when lag(i) over (partition by doc_id order by i) + 100 >= i then 0 else 1 end as fresh from r where k > 1),
q as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from g),
x as (select doc_id, run, min(i) as a, max(i) + 100 as z from q group by doc_id, run),
y as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from x),
k as (select d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept, max(z) as last, sum(z - a) as removed, count(*) as spans
      from y join d using (doc_id) group by d.doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join k using (doc_id)"""

#: op3: first lines, then all pairs that share a first or last word and differ by one word at most in number; of lines of
#: fewer than 8 words, all pairs that are equal without one character.
LINES = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls, coalesce(text, '') as text from documents),
l as (select doc_id, generate_subscripts(ls, 1) - 1 as k, unnest(ls) as x from d),
c as (select * from l where trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
f as (select x, arg_min(doc_id, (doc_id, k)) as fd, arg_min(k, (doc_id, k)) as fk from c group by x),
w as (select x, fd, fk, string_split(x, ' ') as w, len(string_split(x, ' ')) as n from f where len(string_split(x, ' ')) >= 8),
p as (select a.x as ax, b.x as bx, a.w as aw, b.w as bw, a.n as an, b.n as bn, (a.fd, a.fk) > (b.fd, b.fk) as later from w a join w b on a.w[1] = b.w[1] and a.x <> b.x and b.n in (a.n, a.n + 1)
      union all select a.x, b.x, a.w, b.w, a.n, b.n, (a.fd, a.fk) > (b.fd, b.fk) from w a join w b on a.w[a.n] = b.w[b.n] and a.w[1] <> b.w[1] and b.n in (a.n, a.n + 1)),
m as (select *, coalesce(list_position(list_transform(list_zip(aw, bw[1:an]), lambda z: z[1] <> z[2]), true), an + 1) as pos from p),
short as (select x, fd, fk, length(x) as n from f where len(string_split(x, ' ')) < 8 and length(x) >= 16),
v as (select x, fd, fk, i, substr(x, 1, i - 1) || substr(x, i + 1) as less from (select *, unnest(range(1, n + 1)) as i from short) t),
near as (select distinct case when later then ax else bx end as x from m where case when an = bn then aw[pos + 1:an] = bw[pos + 1:bn] else aw[pos:an] = bw[pos + 1:bn] end
      union select case when (a.fd, a.fk) > (b.fd, b.fk) then a.x else b.x end from v a join v b on a.less = b.less and a.i = b.i and a.x <> b.x
      union select case when (a.fd, a.fk) > (b.fd, b.fk) then a.x else b.x end from v a join short b on a.less = b.x),
kept as (select l.doc_id, l.k, l.x from l left join f on l.x = f.x left join near on l.x = near.x
         where f.x is null or (near.x is null and (f.fd, f.fk) = (l.doc_id, l.k))),
t as (select doc_id, count(*) as n, string_agg(x, chr(10) order by k) as text from kept group by doc_id)
select d.doc_id, len(d.ls)::bigint as n_lines, (len(d.ls) - coalesce(t.n, 0))::bigint as n_removed, length(coalesce(t.text, ''))::bigint as n_kept_chars, sha256(coalesce(t.text, '')) as kept_sha256
from d left join t using (doc_id)"""

_WALK = """
e as (select a, b from links union all select b, a from links),
walk as (select a as node, a as top from e union select e.b, walk.top from walk join e on e.a = walk.node where walk.top < e.b),
c as (select node, min(top) as component_id from walk group by node)"""

#: op5: sets of shingles, pairs that share one, and their Jaccard similarity.
JACCARD = rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0) t),
z as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join z za on za.doc_id = a join z zb on zb.doc_id = b where 100 * k >= 75 * (za.n + zb.n - k)),{_WALK}
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id from d left join z using (doc_id) left join c on c.node = d.doc_id"""

#: op10: all pairs of vectors.
VECTORS = f"""
with recursive v as (select vec_id, embedding::double[] as x from embeddings),
ok as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) as size from v where x is not null and len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0),
links as (select p.vec_id as a, q.vec_id as b from ok p join ok q on p.vec_id < q.vec_id and p.size > 0 and q.size > 0 and len(p.x) = len(q.x)
          where list_dot_product(p.x, q.x) / (p.size * q.size) >= 0.9),{_WALK},
n as (select a as vec_id, count(*) as n from e group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.component_id, v.vec_id)::bigint as component_id, v.vec_id = coalesce(c.component_id, v.vec_id) as kept
from v left join n using (vec_id) left join c on c.node = v.vec_id"""

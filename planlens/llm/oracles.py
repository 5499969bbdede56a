"""DuckDB SQL for the queries that SQL can express, each by its plain definition."""

from __future__ import annotations

_OP2 = """
with d as (select doc_id, coalesce(text, '') as body from documents),
g as (select body, count(*) as group_size, max(doc_id) as keep_id from d group by body)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.body) as text_sha256
from d join g using (body)
"""

_OP11 = """
with recursive v as (
  select vec_id as id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0
),
link as (select a.id as x, b.id as y from v a join v b on a.id <> b.id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select id as x, id as y from v union select r.x, l.y from reach r join link l on r.y = l.x),
least as (select x, min(y) as component_id from reach group by x),
degree as (select x, count(*) as n from link group by x)
select e.vec_id, coalesce(d.n, 0) as n_links, coalesce(l.component_id, e.vec_id) as component_id, coalesce(l.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join least l on l.x = e.vec_id left join degree d on d.x = e.vec_id
"""

_OP12 = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pair as (
  select a.id as a, b.id as b, a.label = b.label as same, list_inner_product(a.e::double[], b.e::double[])::bigint as s
  from v a join v b on a.id % 100 = 0 and a.id <> b.id
),
positive as (
  select a, b, s from pair where same qualify row_number() over (partition by a order by s desc, b) <= 5
)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by n.s desc, n.b) as rank,
  n.b as negative_id, p.s as positive_score, n.s as negative_score
from positive p join pair n on n.a = p.a and not n.same and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s
qualify row_number() over (partition by p.a, p.b order by n.s desc, n.b) <= 10
"""

_OP13 = r"""
with token as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
),
tf as (select doc_id, term, count(*) as tf from token group by all),
size as (select doc_id, count(*) as n from token group by doc_id),
total as (select count(*) as docs, sum(n)::bigint as len from size),
weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, docs),
norm as (select doc_id, 100 - 90 + ((90 * n * docs) // len) as m from size, total),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join tf using (term) join weight using (term) join norm using (doc_id) group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""

ORACLES: dict[str, str] = {"op2_exact_dedup": _OP2, "op11_embedding_dedup": _OP11, "op12_hard_negatives": _OP12, "op13_lexical_search": _OP13}

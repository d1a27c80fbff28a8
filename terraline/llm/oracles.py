"""SQL that says what some of the numbered queries return."""

from __future__ import annotations

from terraline.llm.mixing import TOKEN
from terraline.llm.secrets import RULES

_FOUND = " union all ".join(
    f"""select doc_id, {place} as place, '{r.kind}' as kind, a as start, a + length(m[k]) as stop, {f"length(v[k]) >= {r.least}" if r.group else "true"} as good from (
  select doc_id, m, v, k, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) as a from (
    select doc_id, m, g, v, unnest(range(1, len(m) + 1)) as k from (select doc_id, regexp_extract_all(t, $${r.pattern.replace("(?<![0-9a-f])", "")}$$) as m, string_split_regex(t, $${r.pattern.replace("(?<![0-9a-f])", "")}$$) as g, regexp_extract_all(t, $${r.pattern.replace("(?<![0-9a-f])", "")}$$, {r.group}) as v from d)))"""
    for place, r in enumerate(RULES)
)
OP4 = f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as (select * from ({_FOUND}) where good),
  s as (select doc_id, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, place) filter (place < 3) as base, string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, place) as spans from f group by 1)
  select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join s on d.doc_id = s.doc_id"""

OP5 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256.0e0 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
  select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

#: Bytes are pairs of hexadecimal digits here; every window of 100 that is not its first occurrence covers its bytes.
OP6 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  w as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) as i from d)),
  f as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w) where k > 1),
  g as (select doc_id, i, coalesce(i > max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), true) as begins from f),
  r as (select doc_id, min(i) as a, max(i) + 100 as b from (select doc_id, i, count_if(begins) over (partition by doc_id order by i) as k from g) group by doc_id, k),
  p as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as before from r),
  k as (select p.doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from p join d on d.doc_id = p.doc_id group by 1)
  select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k on k.doc_id = d.doc_id"""

OP7 = r"""with t as (select doc_id, source, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
  g as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
  r as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as n from g) where n > 1),
  c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i+1, i+2]) as p from r) group by 1),
  s as (select t.doc_id, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from t left join c on t.doc_id = c.doc_id),
  f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines as soft_failed from s),
  h as (select source, count(*) as n, count_if(base_failed or soft_failed)::double as k from f group by 1),
  m as (select sum(k) / sum(n) as mean, sum(n * (k / n) * (k / n)) / sum(n) as s2 from h),
  p as (select mean, case when s2 - mean*mean <= 0 or mean*(1-mean) <= 0 then 1000.0e0 else least(1000.0e0, greatest(1.0e0, mean*(1-mean) / (s2 - mean*mean) - 1)) end as strength from m),
  q as (select source, (k + mean * strength) / (n + strength) as rate from h, p)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, not base_failed and rate <= 0.5 and (not soft_failed or rate < 0.02) as kept from f join q on f.source is not distinct from q.source"""



def _level(depth: int) -> str:
    """Budgets of the nodes of one level: n(depth) with capacity, weight and given becomes b(depth) with budget."""
    names = ("domain", "lang", "source")[:depth]
    keys, parent, order = ", ".join(names), ", ".join(names[:-1]) or "1", "capacity / weight, " + ", ".join(f"{c} nulls first" for c in names)
    by = f"partition by {parent}"
    up = f" join b{depth - 1} b on " + " and ".join(f"t.{c} is not distinct from b.{c}" for c in names[:-1]) if depth > 1 else ""
    given = "max(b.budget)" if depth > 1 else "(select sum(tokens) from leaves)"
    weight = ("wd", "wl", "ws")[depth - 1]
    return f"""n{depth} as (select {", ".join(f"t.{c}" for c in names)}, sum(t.capacity) as capacity, max(t.{weight}) as weight, {given} as given from nodes t{up} group by {", ".join(f"t.{c}" for c in names)}),
  p{depth} as (select *, given - coalesce(sum(capacity) over ({by} order by {order} rows between unbounded preceding and 1 preceding), 0) as rest, sum(weight) over ({by} order by {order} rows between current row and unbounded following) as ws, row_number() over ({by} order by {order}) as place from n{depth}),
  c{depth} as (select *, min(case when capacity * ws > rest * weight then place end) over ({by}) as cut from p{depth}),
  d{depth} as (select *, max(case when place = cut then rest end) over ({by}) as cut_rest, max(case when place = cut then ws end) over ({by}) as cut_ws from c{depth}),
  e{depth} as (select *, case when place >= cut then cut_rest * weight // cut_ws end as share from d{depth}),
  b{depth} as (select {keys}, case when cut is null or place < cut then capacity else share + case when place - cut < cut_rest - sum(share) over ({by}) then 1 else 0 end end as budget from e{depth})"""


def op8(weights: dict[str, dict[str, int]], seed: int, max_epochs: int) -> str:
    """Mixing of all tokens; ``weights`` by level and value, 1 where none is given, all above 0."""
    of = lambda level: f"case {level} " + " ".join(f"when '{v}' then {w}" for v, w in weights[level].items()) + " else 1 end" if weights.get(level) else "1"
    number = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    return f"""with d as (select doc_id, lang, source, case when {number} = '' then 'other' else 'domain' || (cast({number} as integer) % 4) end as domain, len(regexp_extract_all(coalesce(text, ''), $${TOKEN}$$)) as n from documents),
  leaves as (select domain, lang, source, cast(sum(n) as bigint) as tokens from d group by all),
  nodes as (select *, tokens * {max_epochs} as capacity, {of("domain")} as wd, {of("lang")} as wl, {of("source")} as ws from leaves where tokens > 0),
  {_level(1)},
  {_level(2)},
  {_level(3)},
  f as (select l.*, coalesce(b.budget // l.tokens, 0) as epochs, coalesce(b.budget % l.tokens, 0) as rest from leaves l left join b3 b on l.domain = b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
  m as (select d.*, epochs, rest, md5('{seed}:' || (epochs + 1) || ':' || coalesce(cast(doc_id as varchar), 'null')) as mark from d join f on d.domain = f.domain and d.lang is not distinct from f.lang and d.source is not distinct from f.source),
  s as (select *, sum(n) over (partition by domain, lang, source order by mark) as upto from m)
  select * from (select doc_id, domain, lang, source, cast(epochs + case when rest > 0 and upto <= rest then 1 else 0 end as bigint) as n_copies from s) where n_copies > 0"""


#: Units are list elements; chr(10) can be one, so they are matched with (?s).
OP11 = """with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
  x as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
  c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from x),
  f as (select *, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
    array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from c),
  o as (select *, case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from f)
  select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars, sha256(output) as output_sha256, sha256(t) as restored_sha256 from o"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12 = f"""with d as (select doc_id, len(t) as n, t from (select doc_id, {_TERMS} as t from documents)),
  g as (select count_if(n > 0)::bigint as big_n, sum(n)::bigint as big_l from d),
  p as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(t) as term from d) group by all),
  q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
  w as (select term, cast(floor(1000 * ln((2.0e0 * big_n + 2) / (2.0e0 * count(*) + 1))) as bigint) as w from p, g group by term, big_n),
  s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) as bigint) as score from q join w using (term) join p using (term), g group by all)
  select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50"""

OP13 = """with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
  select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from d"""

ORACLES = {"op4_secrets": OP4, "op5_topk": OP5, "op6_substrings": OP6, "op7_quality_rules": OP7, "op11_fill_middle": OP11, "op12_lexical": OP12, "op13_exact_dedup": OP13}

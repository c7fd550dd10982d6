"""SQL that gives the rows of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .filter_audit import LEAST_DISTINCT, LEAST_WORDS, LETTERS, MOST_CAPITALS, SIGNS
from .near_dedup import PERCENT, WORDS
from .ranked_search import B, BASE, LENGTH, SCALE, TF, TOP
from .secret_scan import ACCESS_LEAST, ASSIGN_LEAST, CLASSES, MASK, WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_dedup_sql() -> str:
    """Links by an inverted join on whole shingle strings of documents with different sets; components by reachability."""
    return f"""
with recursive numbered as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
words as (select rid, doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from numbered),
sets as (select rid, doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end)) as s from words),
classes as materialized (select s, min(doc_id) as doc, len(s) as n from sets where len(s) > 0 and doc_id is not null group by s),
postings as materialized (select doc, n, unnest(s) as shingle from classes),
links as materialized (select a.doc as a, b.doc as b from postings a join postings b on a.shingle = b.shingle and a.doc <> b.doc
    group by a.doc, b.doc, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach(node, seen) as (select doc, doc from classes union select reach.node, links.b from reach join links on reach.seen = links.a),
labels as (select node, min(seen) as component from reach group by node),
component as (select sets.rid, labels.component from sets join classes on sets.s = classes.s join labels on labels.node = classes.doc)
select sets.doc_id, len(sets.s)::bigint as n_shingles, case when sets.doc_id is not null then coalesce(component.component, sets.doc_id) end as component_id,
    coalesce(sets.doc_id = coalesce(component.component, sets.doc_id), true) as kept
from sets left join component on sets.rid = component.rid"""


def _either(words: str) -> str:
    """A pattern whose ASCII letters match in either case, and no other letter does."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def secret_scan_sql() -> str:
    """Places are summed from the lengths of matches and of what lies between; each window's entropy is computed anew."""
    assign = f"""({_either("password|passwd|secret|token|api_?key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    found = {  # kind: pattern, group of the value, condition on match m and value v
        "assign": (assign, 2, f"length(v) >= {ASSIGN_LEAST}"),
        "access": ("AKIA[A-Z0-9]+", 0, f"length(m) >= {ACCESS_LEAST}"),
        "hex": ("[0-9a-f]+", 0, "length(m) >= 24"),
        "entropy_hex": (f"[A-Za-z0-9]{{{WINDOW},}}", 0, "regexp_full_match(m, '[0-9a-fA-F]+') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"),
        "entropy_base64": (f"[A-Za-z0-9+/_=-]{{{WINDOW},}}", 0, "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"),
    }
    # SQL patterns have no references back, so each character's repeats are spelled out
    same = "|".join(f"{'[+]' if c == '+' else c}{{8,}}" for c in f"{_LOWER}0123456789+/_=-")
    allow = f"example|sample|dummy|placeholder|change_?me|redacted|lorem|xxxx|your[_-]|0123456789|123456789|abcdefgh|{same}"
    uuid = "regexp_full_match(lower(m), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')"
    parts, spans = [], []
    for rank, (kind, (pattern, group, passes)) in enumerate(found.items()):
        parts.append(f"""
{kind}_lists as (select rid, string_split_regex(text, '{pattern}') as p, regexp_extract_all(text, '{pattern}', 0) as ms, regexp_extract_all(text, '{pattern}', {group}) as vs from texts where regexp_matches(text, '{pattern}')),
{kind}_each as (select rid, generate_subscripts(ms, 1) as k, unnest(ms) as m, unnest(vs) as v, unnest(p[:len(ms)]) as before from {kind}_lists),
{kind}_at as (select rid, m, v, sum(length(before) + length(m)) over (partition by rid order by k) - length(m) as start from {kind}_each),""")
        if rank < 3:
            spans.append(f"select rid, {rank} as rank, '{kind}' as kind, start, start + length(m) as stop from {kind}_at where {passes}")
        else:
            string, least = ("lower(m)", CLASSES[kind][2]) if kind == "entropy_hex" else ("m", CLASSES[kind][2])
            parts.append(f"""
{kind}_masked as (select rid, start, {string} as m, string_split_regex(lower(m), '{allow}') as p, regexp_extract_all(lower(m), '{allow}') as q from {kind}_at where {passes} and not {uuid}),
{kind}_windows as (select rid, start, m, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || repeat('{MASK}', coalesce(length(q[i]), 0))), '') as shown, unnest(range(0, length(m) - {WINDOW - 1})) as o from {kind}_masked),""")
            spans.append(f"""select rid, {rank}, '{kind}', start + min(o), start + max(o) + {WINDOW} from {kind}_windows
    where list_entropy(string_split(substring(m, o + 1, {WINDOW}), '')) >= {least} - 1e-9 and not contains(substring(shown, o + 1, {WINDOW}), '{MASK}') group by rid, start""")
    union = "\nunion all ".join(spans)
    return f"""
with texts as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),{"".join(parts)}
spans as ({union}),
named as (select *, kind || ':' || start::bigint || ':' || stop::bigint as span from spans),
joined as (select rid, count_if(rank = 0) as n_assign, count_if(rank = 1) as n_access, count_if(rank = 2) as n_hex,
    string_agg(span, ',' order by start, rank, stop) filter (where rank < 3) as base, string_agg(span, ',' order by start, rank, stop) as spans from named group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from texts left join joined using (rid)"""


def filter_audit_sql() -> str:
    """Each document goes through all orders by its five failures; what an order removes is counted at each of its steps."""
    return f"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
counted as (select doc_id, part, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from texts),
failed as materialized (select part, len(w) < {LEAST_WORDS} as a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) as b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) as c, regexp_matches(t, '{SIGNS}') as d,
    coalesce(counted.doc_id > min(counted.doc_id) over (partition by t), false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
    from counted left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) marks on counted.doc_id = marks.doc_id),
cells as materialized (select part, [a, b, c, d, e] as f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed group by all),
five as (select unnest(range(1, 6)) as o),
orders as (select [p.o, q.o, r.o, s.o, u.o] as places from five p, five q, five r, five s, five u where len(list_distinct(places)) = 5),
steps as (select part, places, k as step, sum(n) filter (not list_bool_or(list_transform(places[:k], lambda x: f[x]))) as kept,
    sum(n) filter (f[places[k]] and not coalesce(list_bool_or(list_transform(places[:k - 1], lambda x: f[x])), false)) as removed,
    sum(n) filter (f[places[k]] and coalesce(list_bool_or(list_transform(places[:k - 1], lambda x: f[x])), false)) as redundant,
    sum(n) filter (f[places[k]] and len(list_filter(f, lambda x: x)) = 1) as unique_fails,
    sum(good) filter (f[places[k]] and not coalesce(list_bool_or(list_transform(places[:k - 1], lambda x: f[x])), false)) as good_lost,
    sum(toxic) filter (f[places[k]] and not coalesce(list_bool_or(list_transform(places[:k - 1], lambda x: f[x])), false)) as toxic_lost
    from cells, orders, (select unnest(range(1, 6)) as k) group by all)
select part, list_aggregate(list_transform(places, lambda x: '{LETTERS}'[x]), 'string_agg', '') as filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept,
    coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
    coalesce(toxic_lost, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, places[step])::bigint as shapley
from steps"""


def warc_sql() -> str:
    """Copies by their whole text; the digest's forty hexadecimal digits become base32 five at a time."""
    return """
with p as (select page_id, coalesce(html, '') as html from pages),
m as (select page_id, html, sha1(html) as hex, max(page_id) over (partition by html) as first from p)
select page_id, strlen(html)::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substring(hex, (k // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (k % 4))::bigint) & 31)::bigint + 1, 1)), 'string_agg', '') as payload_digest,
    case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
    case when first is not null and (page_id is null or page_id <> first) then first end as refers_to
from m"""


def ranked_search_sql() -> str:
    """Scores by a join of the items' terms with all documents' term counts."""
    terms = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with words as materialized (select row_number() over () as rid, doc_id, {terms} as w from documents),
sizes as materialized (select rid, doc_id, len(w) as n from words where len(w) > 0),
totals as (select count(*) as docs, sum(n)::bigint as terms from sizes),
asked as materialized (select distinct item_id, unnest({terms}) as term from benchmark),
counts as materialized (select rid, term, count(*) as tf from (select rid, unnest(w) as term from words) where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from counts, totals group by term, docs),
impacts as materialized (select rid, term, w * (({SCALE} * tf) // ({TF} * tf + {LENGTH} * ({BASE - B} + ({B} * n * docs) // terms))) as impact
    from counts join weights using (term) join sizes using (rid), totals),
scores as (select item_id, rid, doc_id, sum(impact)::bigint as score from asked join impacts using (term) join sizes using (rid) group by all having sum(impact) > 0)
select item_id, rank::integer as rank, doc_id, score from
    (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as rank from scores) where rank <= {TOP}"""

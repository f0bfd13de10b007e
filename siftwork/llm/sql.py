"""DuckDB SQL for the queries of this subpackage that SQL can express."""

QUALITY = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
win as (select doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', chr(1)) g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, sum(least(8, coalesce(nx - i, 8))) n from (select doc_id, i, lead(i) over (partition by doc_id order by i) nx from dup) group by 1),
m as (select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words,
  len(regexp_extract_all(t, '\p{Lu}'))::bigint up
  from w left join cov using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_symbols > 30 * n_words or 100 * up > 40 * word_chars
    or word_chars < 2 * n_words or word_chars > 25 * n_words or 100 * n_dup_lines > 30 * n_words) kept
from m
"""

NEAR = r"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sh as materialized (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [list_aggregate(ws, 'string_agg', chr(1))]
  else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] || chr(1) || ws[i + 3]) end) s from d),
n as (select doc_id, len(s)::bigint n from sh),
u as materialized (select doc_id, hash(unnest(s)) h from sh),
pairs as materialized (select x.doc_id a, y.doc_id b, count(*) bo from u x join u y on x.h = y.h and x.doc_id < y.doc_id group by 1, 2),
links as materialized (select a, b from pairs join n p on p.doc_id = a join n q on q.doc_id = b where 100 * bo >= 80 * (p.n + q.n - bo)),
e as materialized (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id r from n union select e.a, reach.r from e join reach on e.b = reach.doc_id)
select n.doc_id, n.n n_shingles, min(r) component_id, n.doc_id = min(r) kept from n join reach using (doc_id) group by n.doc_id, n.n
"""

REPEATS = r"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
w as materialized (select doc_id, i, md5(list_aggregate(ws[i:i + 19], 'string_agg', ' ')) g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) i from d where len(ws) >= 20)),
rep as materialized (select doc_id, i from w qualify row_number() over (partition by g order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) k from rep),
words as (select doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) k from d),
kept as (select doc_id, count(*) n, string_agg(x, ' ' order by k) t from words anti join gone using (doc_id, k) group by 1)
select doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)
"""


#: op7: 100 hex digits are 50 bytes.
BYTES = """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
w as materialized (select doc_id, k, hash(substr(h, 2 * k + 1, 100)) g from (select doc_id, h, unnest(range(0, n - 49)) k from d where n >= 50)),
gone as materialized (select doc_id, k, lag(k) over o before, lead(k) over o after from (select doc_id, k from w qualify min(doc_id) over (partition by g) < doc_id) x window o as (partition by doc_id order by k)),
r as (select doc_id, sum(least(50, coalesce(after - k, 50)))::bigint removed, count(*) filter (before is null or k - before > 50) spans from gone group by 1),
pieces as (select doc_id, k + 50 a, coalesce(after, n) b from gone join d using (doc_id) where coalesce(after, n) > k + 50 union all select doc_id, 0, min(k) from gone group by 1),
kept as (select doc_id, string_agg(substr(h, (2 * a + 1)::int, (2 * (b - a))::int), '' order by a) h from pieces join d using (doc_id) group by 1)
select doc_id, n::bigint n_bytes, coalesce(removed, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(kept.h, case when removed is null then d.h else '' end))) kept_sha256
from d left join r using (doc_id) left join kept using (doc_id)
"""

#: op10, for pages that mark their article: its blocks, without tags, with references decoded.
ARTICLES = r"""
select page_id, url, t text, length(t)::bigint n_chars from (select page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1), '<br>', ' '), '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*(>|$)', '', 'g'), '&quot;', '"'), '&amp;', chr(1)), '&amp', chr(1)), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) t0, replace(t0, chr(1), '&') t from pages) p
"""


#: op1's base kinds as the contract gives them: kind, pattern, the group whose length counts, its least length.
SECRETS = [
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]


def _spans(more) -> str:
    """Every rule's matches with their places: lengths of what stands between and of the matches, summed up."""
    each = []
    for k, (kind, pattern, group, least) in enumerate([*SECRETS, *[(r.kind, r.pattern.replace("'", "''"), r.group, r.least) for r in more]]):
        each.append(f"select doc_id, {k} kind_no, '{kind}' kind, unnest(regexp_extract_all(t, '{pattern}')) m, unnest(regexp_split_to_array(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) gap, unnest(range(len(regexp_extract_all(t, '{pattern}')))) i, {least} least, {f"length(regexp_extract(m, '{pattern}', {group}))" if group else 'length(m)'} size from d")
    return " union all ".join(each)


def secret_spans() -> str:
    from siftwork.llm.secrets import MORE

    kinds = [k for k, *_ in SECRETS]
    said = "kind || ':' || (stop - length(m)) || ':' || stop"
    base = ", ".join(f"'{k}'" for k in kinds)
    return f"""
with d as materialized (select doc_id, coalesce(text, '') t from documents), m as materialized ({_spans(MORE)}),
p as (select *, (sum(length(gap) + length(m)) over (partition by doc_id, kind_no order by i))::bigint stop from m), s as (select * from p where size >= least),
g as (select doc_id, {', '.join(f"count(*) filter (kind = '{k}') n_{k}" for k in kinds)}, string_agg({said}, ',' order by stop - length(m), kind_no) filter (kind in ({base})) b, string_agg({said}, ',' order by stop - length(m), kind_no) spans from s group by 1)
select doc_id, {', '.join(f'coalesce(n_{k}, 0) n_{k}' for k in kinds)}, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans from d left join g using (doc_id)
"""


def license_labels() -> str:
    from siftwork.llm.licenses import TEMPLATES, template_regex

    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    base = ", ".join(f"case when contains(j, ' {p} ') then '{k}' end" for p, k in phrases.items())
    more = ", ".join(f"""case when regexp_matches(j, ' {template_regex(t).replace(chr(92) + "-", "-")}') then '{k}' end""" for k, t in TEMPLATES.items())
    at = " or ".join("(" + " and ".join(f"ws[i{f' + {n}' if n else ''}] = '{w}'" for n, w in enumerate(p.split())) + ")" for p in phrases)
    joined = "coalesce(list_aggregate(list_sort(list_distinct(list_filter({}, lambda x: x is not null))), 'string_agg', ','), '')"
    return rf"""
with d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
j as materialized (select doc_id, ws, ' ' || coalesce(list_aggregate(ws, 'string_agg', ' '), '') || ' ' j from d),
p as (select doc_id, ws, j, list_filter(range(1, len(ws) + 1), lambda i: {at}) spot, [{base}] b, [{more}] m from j)
select doc_id, len(ws)::bigint n_words, len(spot)::bigint n_base, spot[1] - 1 first_word, spot[-1] - 1 last_word, {joined.format('b')} base_labels, {joined.format('list_concat(b, m)')} labels,
  case when len(list_filter(m, lambda x: x is not null)) > 0 then 1.0::double when len(spot) > 0 then 0.5::double else 0.0::double end score from p
"""


def fingerprints() -> str:
    from siftwork.llm.spotsigs import COMMON

    common = ", ".join(f"'{w}'" for w in sorted(COMMON))
    return rf"""
with d as (select doc_id, coalesce(text, '') t from documents), o as materialized (select doc_id, t, coalesce(lead(t) over (order by doc_id), (select arg_min(t, doc_id) from d)) nt, coalesce(lead(doc_id) over (order by doc_id), (select min(doc_id) from d)) nd from d),
x as materialized (select doc_id, nd, 0 kind, t from o union all select doc_id, nd, 1, case when length(t) < 4 then t else substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) end from o),
w as (select doc_id, kind, unnest(ws) w, unnest(range(len(ws))) i from (select doc_id, kind, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') ws from x) y),
c as materialized (select *, w in ({common}) com, count(*) filter (w not in ({common})) over (partition by doc_id, kind order by i) k from w),
n as materialized (select doc_id, kind, k, w from c where not com),
sig as (select distinct a.doc_id, a.kind, substr(md5(a.w || ' ' || p.w || ' ' || q.w), 1, 8) s from c a join n p on p.doc_id = a.doc_id and p.kind = a.kind and p.k = a.k + 1 join n q on q.doc_id = a.doc_id and q.kind = a.kind and q.k = a.k + 2 where a.com),
f as materialized (select x.doc_id, x.kind, x.nd, x.t, coalesce(l, list_sort(list_distinct([substr(md5(x.t), 1, 8), substr(md5(x.t), 9, 8), substr(md5(x.t), 17, 8), substr(md5(x.t), 25, 8)]))) l from x left join (select doc_id, kind, list(s order by s) l from sig group by 1, 2) g using (doc_id, kind)),
m as (select a.doc_id, length(a.t)::bigint n_chars, sha256(b.t) edited_sha256, a.l la, b.l lb, e.l le from f a join f b on b.doc_id = a.doc_id and b.kind = 1 join f e on e.doc_id = a.nd and e.kind = 0 where a.kind = 0)
select doc_id, n_chars, edited_sha256, list_aggregate(la, 'string_agg', '') fingerprint, list_aggregate(lb, 'string_agg', '') edited_fingerprint, len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb))) near_edited, len(list_intersect(la, le)) / len(list_distinct(list_concat(la, le))) near_next from m
"""


def fingerprint_links() -> str:
    """Pairs of classes by brute force: signatures joined and counted."""
    head = fingerprints().split("m as (select a.doc_id, length(a.t)")[0].rstrip().rstrip(",")
    return head + """,
  k as materialized (select doc_id, l, min(doc_id) over (partition by l) class_id from f where kind = 0), cl as materialized (select class_id, any_value(l) l from k group by 1), u as materialized (select class_id, len(l) n, unnest(l) s from cl),
  p as materialized (select a.class_id a, b.class_id b, any_value(a.n) na, any_value(b.n) nb, count(*) nab from u a join u b on a.s = b.s and a.class_id <> b.class_id group by 1, 2),
  q as (select a, count(*) n_links from p where nab >= 0.8 * (na + nb - nab) group by 1)
select doc_id, class_id, coalesce(n_links, 0) n_links from k left join q on q.a = class_id"""


ORACLES = {
    "spotsigs_links": fingerprint_links(),
    "op8_spotsigs": fingerprints(),
    "op1_secret_scans": secret_spans(),
    "op2_license_scans": license_labels(),
    "op4_minhash_dedup": NEAR,
    "op5_block_dedup": REPEATS,
    "op7_suffix_dedup": BYTES,
    "op9_quality_rules": QUALITY,
    "op10_html_extraction": ARTICLES,
}

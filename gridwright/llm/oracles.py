"""What DuckDB must find for the queries that SQL can express."""

from __future__ import annotations

#: The six white-space characters of the word rule.
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = rf"""
with raw as (select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
    regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|tr|table|article|section|header|footer|title|body|head|html)(?:\s[^<>]*)?/?>', chr(10), 'g') as t from pages),
txt as (select page_id, host, string_split(trim(regexp_replace(regexp_replace(regexp_replace(t, '<[^<>]*>', '', 'g'), '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), {WS}), chr(10)) as l from raw),
own as (select host, unnest(list_distinct(list_filter(list_transform(l, lambda x: trim(x, {WS})), lambda x: x <> ''))) as line from txt),
totals as (select host, count(*) as n from txt group by 1),
bad as (select o.host, o.line from own o join totals t on o.host = t.host group by o.host, o.line, t.n having count(*) >= 5 and count(*) > 0.02 * t.n),
by_host as (select host, list(line) as b from bad group by 1),
kept as (select page_id, txt.host, l, list_filter(l, lambda x: not list_contains(coalesce(b, []::varchar[]), trim(x, {WS})) or trim(x, {WS}) = '') as k from txt left join by_host on txt.host = by_host.host)
select page_id, host, array_to_string(k, chr(10)) as text, cast(len(l) - len(k) as int) as n_dropped from kept"""

QUALITY_RULES = rf"""
with w as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WS}) <> '') as lines from documents),
win as (select doc_id, p, array_to_string(ws[p:p + 7], ' ') as v from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as p from w)),
again as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, v) as c from win) where c > 1),
covered as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(p, p + 8)) as q from again) group by 1),
base as (select w.doc_id, host, text, lines, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words from w left join covered c on w.doc_id = c.doc_id),
flagged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, list_transform(lines, lambda x: regexp_replace(regexp_replace(lower(trim(x, {WS})), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) as normal from base),
texts as (select host, text, any_value(normal) as normal from flagged group by 1, 2),
totals as (select host, count(*) as n from texts group by 1),
seen as (select host, line, count(*) as n from (select host, unnest(list_distinct(normal)) as line from texts) group by 1, 2),
common as (select s.host, s.line from seen s join totals t on s.host = t.host where s.n >= 20 and s.n > 0.02 * t.n),
lost as (select doc_id, sum(n) as lost from (select doc_id, host, unnest(normal) as line, unnest(list_transform(lines, lambda x: len(regexp_split_to_array(trim(x, {WS}), '[\x20\x09-\x0D]+')))) as n from flagged) l join common c on l.host = c.host and l.line = c.line group by 1)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cast(n_words - coalesce(lost, 0) as bigint) as n_words_left,
    not base_failed and not (coalesce(lost, 0) > 0 and (n_words - coalesce(lost, 0) < 20 or n_words - coalesce(lost, 0) < 0.3 * n_words)) as kept
from flagged f left join lost on f.doc_id = lost.doc_id"""

EXACT_TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

WARC_FIXITY = r"""
with r as (select page_id as id, page_id // 256 as file, coalesce(html, '') as body, strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:gridwright:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\x00-\x20]', '', 'g') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)) + strlen(coalesce(html, '')) + 4 as length from pages),
o as (select *, coalesce(sum(length) over (partition by file order by id rows between unbounded preceding and 1 preceding), 0) as start, file % 3 = 1 and id % 101 = 50 as lost, id % 389 = 11 and body <> repeat('0', strlen(body)) or id % 389 <> 11 and id % 97 = 5 as changed from r),
news as (select file, -1 - id as id, 8 as length from o where id % 211 = 7 and not lost),
placed as (select file, id, length, coalesce(sum(length) over (partition by file order by id rows between unbounded preceding and 1 preceding), 0) as start from news)
select cast(file as bigint) as file, cast(start as bigint) as offset, id as left_id, case when not lost then id end as right_id, cast(length as bigint) as left_length, case when not lost then cast(length as bigint) end as right_length, case when lost then 'missing' else 'changed' end as status from o where lost or changed
union all select cast(file as bigint), cast(start as bigint), null, id, null, cast(length as bigint), 'extra' from placed"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op5_quality_rules": QUALITY_RULES,
    "op6_exact_topk": EXACT_TOPK,
    "op9_warc_fixity": WARC_FIXITY,
}

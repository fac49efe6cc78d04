"""SQL (DuckDB) with the same answers as the queries of the catalog, where SQL can say it."""

from chronosift.llm import quality, urls

_STRICT = ", ".join(f"'{t}'" for t in urls.STRICT)
_SOFT = ", ".join(f"'{t}'" for t in urls.SOFT)

SQL: dict[str, str] = {

    "op1_block_join": """
with v as (select vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, v.vec_id,
            list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) as score
          from v q join v on v.vec_id <> q.vec_id and len(v.e) = len(q.e) where q.vec_id % 50 = 0)
select query_id, cast(nth as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as nth from pairs) where nth <= 5""",

    "op2_quality_rules": rf"""
with base as (select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln from base),
places as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c
           from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
again as (select r, i from (select *, count(*) over (partition by r, a, b, c) as n from places) where n > 1),
covered as (select r, count(distinct i + d) as n from again, (values (0), (1), (2)) as s(d) group by r),
m as (select w.r, doc_id, stratum, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ln) - list_unique(ln) as n_dup_lines,
        coalesce(n, 0) as n_repeat_words, len(ln) as n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_capitals
      from w left join covered on w.r = covered.r),
j as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words as base_failed from m),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
rated as (select r, doc_id, stratum, base_failed, rule, cast(floor({quality.BINS} * case when whole > 0 then least(1.0, part::double / whole) else 0 end) as integer) as bin
  from (select *, unnest(['symbols', 'lines', 'repeats', 'shouting']) as rule,
          unnest([n_symbols, n_dup_lines, n_repeat_words, n_capitals]) as part,
          unnest([n_words, n_lines, n_words, word_chars]) as whole from j)),
held as (select stratum, rule, bin from rated join good using (doc_id) where not base_failed),
tests as (select count(*) as m from (select distinct stratum, rule from held)),
tried as (select stratum, rule, cut, count(*) as n, count(*) filter (bin >= cut) as k
          from held, range(1, {quality.BINS + 2}) as g(cut) group by all),
passed as (select stratum, rule, min(cut) as cut from tried, tests
  where case when k >= n * {quality.RISK} then false else list_sum(list_transform(range(0, k + 1), lambda i: exp(
      lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK}))))
    <= {quality.ERROR} / m end group by stratum, rule),
broken as (select r, rule from rated join passed using (stratum, rule) where bin >= cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and b.rules is null as kept, coalesce(b.rules, '') as rules
from j left join (select r, string_agg(rule, ',' order by list_position(['symbols', 'lines', 'repeats', 'shouting'], rule)) as rules
                  from broken group by r) b using (r)""",

    "op8_urls": rf"""
with u as (select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as pos from pages),
p as (select page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
        case when pos > 0 then translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from u),
h as (select *, len(list_filter([{_STRICT}], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) as strict_terms,
        len(list_filter([{_SOFT}], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) as soft_terms,
        cast((select count(*) from unnest([{_STRICT}]) as s(t), unnest(range(1, length(low) + 1)) as g(i)
         where substr(low, i, length(t)) = t and not regexp_matches(substr(low, i - 1, 1), '[a-z0-9]')
           and not regexp_matches(substr(low, i + length(t), 1), '[a-z0-9]')) as integer) as strict_hits,
        case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
             when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
             when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
             when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
       when strict_terms >= 1 or soft_terms >= 2 then 'block' else 'allow' end as verdict,
  strict_hits, cast(soft_terms as integer) as soft_terms from h""",

    "op10_mixing": r"""
with d as (select doc_id, coalesce(source, '') as s0, source is null as no_source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
             ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h
           from documents),
s as (select s0, no_source, sum(size)::bigint as source_size from d group by all),
n as (select *, [1.0, 2.0, 3.0][(row_number() over (order by no_source, s0) - 1) % 3 + 1]::double as w from s),
c as (select *, 3.0::double * source_size as cap from n),
o as (select *, row_number() over (order by cap / w, s0, no_source) as nth,
        sum(cap) over (order by cap / w, s0, no_source rows between unbounded preceding and 1 preceding) as before,
        sum(w) over (order by cap / w, s0, no_source rows between current row and unbounded following) as weights from c),
r as (select (select sum(source_size) from s) as total),
rate as (select (total - coalesce(before, 0)) / weights as rate from o, r
         where (total - coalesce(before, 0)) / weights <= cap / w order by nth limit 1),
t as (select s0, no_source, source_size, least(cap, rate * w) as target from c, rate),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
a as (select d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size as need,
        coalesce(sum(d.size) over (partition by d.s0, d.no_source order by h rows between unbounded preceding and 1 preceding), 0) as before
      from d join g on d.s0 = g.s0 and d.no_source = g.no_source)
select doc_id, size, source_size, target,
  cast(whole * size + case when before + size <= need then size
       when before <= need and 2 * (need - before) >= size then size else 0 end as bigint) as taken from a""",
}


SQL["op11_conversations"] = r"""
with recursive crc as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) as t(i))),
place as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as p from conversations),
drawn as (select place.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(p, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as draw from place, crc),
rows as (select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(case draw when 0 then [] when 3 then [1, 2] else [1] end) as time from drawn)),
c as (select coalesce(conv_id::varchar, ' ') as k, *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final from rows),
g as (select *, row_number() over (partition by conv_id, role, text order by i) as nth from c),
f as (select *, case when final = '' then 'blank' when nth > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end as fault,
    left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as earlier from g),
s as (select conv_id, any_value(k) as k, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (i > 1 and coalesce(earlier, '') || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
steps(b, ins, mid) as (values (1, 0, 1), (1, 1, 3), (1, 2, 4), (2, 0, 2), (2, 1, 3), (2, 2, 4), (3, 0, 3), (3, 1, 4), (3, 2, 3), (4, 0, 4), (4, 1, 3), (4, 2, 4)),
added as (select *, repeat('I', ins) as letters, list_transform(range(ins), lambda n: case when (b = 3) = (n % 2 = 0) then 'assistant:' else 'user:' end) as lines from steps),
moves(mid, initial, after) as (values (1, 's', 2), (1, 'u', 3), (2, 'u', 3), (3, 'a', 4), (4, 'u', 3)),
ways as (
  select k, i, b, mid as a, 3 * ins + 4 as cost, letters || 'D' as w, lines from f, added
  union all select k, i, b, case mid when 3 then 4 else 3 end, 3 * ins + 3 + case fault when 'truncated' then 3 else 0 end, letters || 'R',
    list_append(lines, case mid when 3 then 'assistant:' else 'user:' end || text) from f, added where fault in ('', 'truncated')
  union all select k, i, b, after, 3 * ins + case fault when 'truncated' then 3 else 0 end, letters || 'K', list_append(lines, role || ':' || text)
    from f join moves using (initial) join added using (mid) where fault in ('', 'truncated')),
options as (select k, i, list({b: b, a: a, cost: cost, w: w, lines: lines}) as opts from ways group by k, i),
walk as (
  select k, 0::bigint as i, [{cost: 0, w: '', lines: []::varchar[]}, {cost: 1000000, w: '', lines: []::varchar[]},
    {cost: 1000000, w: '', lines: []::varchar[]}, {cost: 1000000, w: '', lines: []::varchar[]}] as st from s
  union all
  select walk.k, walk.i + 1, list_transform([1, 2, 3, 4], lambda t: coalesce(list_sort(list_transform(list_filter(opts, lambda o: o.a = t),
      lambda o: {cost: st[o.b].cost + o.cost, w: st[o.b].w || o.w, lines: list_concat(st[o.b].lines, o.lines)}))[1],
      {cost: 1000000, w: '', lines: []::varchar[]}))
  from walk join options on options.k = walk.k and options.i = walk.i + 1),
ends as (select s.k, list_sort([{cost: st[1].cost, w: st[1].w, lines: st[1].lines},
    {cost: st[2].cost + 6, w: st[2].w || 'II', lines: list_concat(st[2].lines, ['user:', 'assistant:'])},
    {cost: st[3].cost + 3, w: st[3].w || 'I', lines: list_append(st[3].lines, 'assistant:')},
    {cost: st[4].cost, w: st[4].w, lines: st[4].lines}])[1] as best from walk join s on s.k = walk.k and s.n = walk.i)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.w, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join s on o.conv_id is not distinct from s.conv_id left join ends using (k)"""


SQL["op13_decontamination"] = r"""
with low as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low),
b as (select distinct coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item, least(len(ws), 10) as span, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as w
       from (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
spans as (select distinct span from bw),
dw as (select r, span, i, array_to_string(ws[i:i + span - 1], ' ') as w
       from (select r, ws, span, unnest(range(1, len(ws) - span + 2)) as i from d, spans where len(ws) >= span)),
hit as (select r, span, i, item from dw join bw using (span, w)),
places as (select r, count(distinct i + d) as n_hit from (select distinct r, i, unnest(range(span)) as d from hit) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (r) left join named using (r)"""

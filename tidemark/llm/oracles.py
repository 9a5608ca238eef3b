"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, licenses, quality, resampling, urls


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({text}), {_q(licenses.OWN_NOTICE)}, '', 'g'), {_q(licenses.COPYRIGHT_LINE)}, '', 'g'), {_q(licenses.PUNCTUATION)}, '', 'g')"


def _digest(plain: str) -> str:
    for spelling, stands in licenses.SPELLINGS:
        plain = f"replace({plain}, {_q(spelling)}, {_q(stands)})"
    return f"sha256({plain})"


OP1 = f"""
with known as (select * from (values {', '.join(f"({_q(d)}, {_q(name)})" for name, _, _, d in licenses.known_entries())}) k(digest, name)),
rows_ as (select row_number() over () as r, doc_id, text from documents),
plain as (select r, {_plain('text')} as p from rows_ where text is not null),
lines as (select r, replace(p, chr(10), '') as w, list_filter(string_split(p, chr(10)), lambda x: x <> '') as l from plain),
units as (
  select r, true as whole, {_digest('w')} as digest from lines where len(l) > 0
  union all select r, false, {_digest('x')} from (select r, unnest(l) as x from lines where len(l) > 1)
), found as (
  select r, min(case when whole then name end) as license,
    string_agg(distinct case when not whole then name end, ',' order by case when not whole then name end) as notices,
    count(case when not whole then 1 end) as n from units join known using (digest) group by r
)
select d.doc_id, f.license, coalesce(f.notices, '') as notices, coalesce(f.n, 0)::bigint as n_notice_lines
from rows_ d left join found f on d.r = f.r
"""


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, {_q(urls.PARTS)}, 1), '{urls.UPPER}', '{urls.LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, {_q(urls.PARTS)}, 2)"


def _node(url: str) -> str:
    scheme = f"lower(split_part({url}, '://', 1))"
    host = f"regexp_replace({_host(url)}, case {scheme} when 'http' then ':80$' when 'https' then ':443$' else ':$' end, '')"
    return f"case when contains({url}, '://') then {host} || coalesce(nullif({_path(url)}, ''), '/') || regexp_extract({url}, {_q(urls.PARTS)}, 3) end"


def _attribute(tag: str, pattern: str) -> str:
    return "(" + " || ".join(f"regexp_extract({tag}, {_q(pattern)}, {i})" for i in (1, 2, 3)) + ")"


def _without_dots(path: str) -> str:
    stack = f"""list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]),
      lambda acc, s: case when s[1] = '..' then acc[1:greatest(len(acc) - 1, 1)] when s[1] = '.' then acc else list_concat(acc, s) end)"""
    closed = f"array_to_string({stack}, '/') || case when regexp_matches({path}, '/[.]{{1,2}}$') then '/' else '' end"
    return f"case when contains({path}, '/.') then {closed} else {path} end"


def _resolve(base: str, target: str) -> str:
    """SQL for the address that ``target`` names; both are columns."""
    scheme, path = f"split_part({base}, '://', 1)", _path(base)
    site = f"{scheme} || '://' || regexp_extract({base}, {_q(urls.PARTS)}, 1)"
    folder = f"case when contains({path}, '/') then regexp_extract({path}, '(?s)^(.*/)', 1) else '/' end"
    web = f"regexp_matches({target}, {_q(urls.SCHEME)})"
    return f"""case when contains({target}, '://') and {web} then {target} when {target} = '' or starts_with({target}, '#') or {web} then null
      when starts_with({target}, '//') then {scheme} || ':' || {target} when starts_with({target}, '/') then {site} || {target}
      when starts_with({target}, '?') then {site} || {path} || {target} else {site} || {folder} || {target} end"""


def _tidy(full: str) -> str:
    return f"split_part({full}, '://', 1) || '://' || regexp_extract({full}, {_q(urls.PARTS)}, 1) || {_without_dots(_path(full))} || regexp_extract({full}, {_q(urls.PARTS)}, 3)"


def _clean(target: str) -> str:
    return f"trim(regexp_replace({target}, {_q(urls.AMPERSAND)}, '&', 'g'))"


_FITS = """select p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) as rule, max_by(r.verdict, length(r.host || r.path)) as verdict
  from places p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by p.host, p.path"""

OP5 = f"""
with recursive rules as (select * from (values {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}) r(host, path, verdict)),
mentions as (
  select row_number() over () as r, url, regexp_replace(html, {_q(urls.COMMENT)}, '', 'g') as html from pages where contains(url, '://') and regexp_matches(html, {_q(urls.MENTIONS)})
), tags as (
  select r, {_attribute('t', urls.HREF)} as t from (select r, unnest(regexp_extract_all(html, {_q(urls.LINK)})) as t from mentions) where regexp_matches(t, {_q(urls.REL)})
  union all select r, regexp_extract({_attribute('t', urls.CONTENT)}, {_q(urls.REFRESH)}, 1) from (select r, unnest(regexp_extract_all(html, {_q(urls.META)})) as t from mentions) where regexp_matches(t, {_q(urls.EQUIV)})
), bases as (select r, url, {_clean(_attribute(f"regexp_extract(html, {_q(urls.BASE)})", urls.HREF))} as b from mentions),
based as (select r, url, {_resolve('url', 'b')} as whole_ from bases),
placed as (select r, url, coalesce({_tidy('whole_')}, url) as base from based),
named as (select url, {_resolve('base', 'to_')} as whole_ from (select url, base, {_clean('t')} as to_ from tags join placed using (r))),
links as (
  select distinct {_node('url')} as a, {_node('t')} as b from (select url, {_tidy('whole_')} as t from named where whole_ is not null)
), edges as (select a, b from links where a <> b union select b, a from links where a <> b),
reach as (select distinct a as node, a as other from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
rows_ as (select page_id, coalesce({_host('url')}, '') as host, coalesce({_path('url')}, '') as path, {_node('url')} as node from pages),
parts as (select distinct other as node, {_host("('x://' || other)")} as host, {_path("('x://' || other)")} as path from reach),
places as (select host, path from rows_ union select host, path from parts),
ruled as ({_FITS}),
passed as (select r.node, bool_or(u.verdict = 'allow') as let from reach r join parts p on r.other = p.node join ruled u using (host, path) group by r.node)
select w.page_id, w.host, w.path, u.rule, coalesce(u.verdict, case when s.let then 'allow' when s.let is not null then 'block' end, 'allow') as verdict
from rows_ w left join ruled u using (host, path) left join passed s on s.node = w.node
"""

_HEAD, _TAIL = f"'{chat.OPEN}' || role || chr(10)", f"'{chat.CLOSE.rstrip()}' || chr(10)"
_SIDE = """coalesce(string_agg({what}, '{sep}' order by turn nulls first, role, text) filter (where {where}), '')"""
_DONE = "chosen = {flag} and i > n"
_SPAN = f"case when role = 'assistant' then (offset_ + length({_HEAD}))::varchar || '-' || (offset_ + length({_HEAD}) + length(text) + {chat.END_MARK})::varchar end"

_NEIGHBOURS = """t as (
  select conv_id // 2 as pair_id, conv_id % 2 = 0 as chosen, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
)"""
_REANSWERED = """l as (
  select conv_id, turn, text from conversations where role = 'assistant' and conv_id is not null
  qualify row_number() over (partition by conv_id order by turn desc nulls last, text desc nulls last) = 1
), t as (
  select pair_id, chosen, turn, coalesce(role, '') as role, coalesce(text, '') as text from (
    select c.conv_id as pair_id, true as chosen, c.turn, role, c.text from conversations c join l using (conv_id)
    union all select c.conv_id, false, c.turn, role, c.text from conversations c join l using (conv_id) where c.turn < l.turn or c.turn is null and l.turn is not null
    union all select l.conv_id, false, l.turn, 'assistant', o.text from l left join l o on o.conv_id = l.conv_id + 1 - 2 * (l.conv_id % 2)
  )
)"""


def _pairs(turns: str) -> str:
    """Prefixes, completions and masks of the pairs in ``t`` of the given tables."""
    return f"""
with {turns}, o as (select *, row_number() over (partition by pair_id, chosen order by turn nulls first, role, text) as i from t),
m as (
  select a.pair_id, a.i, b.i is not null and a.role = b.role and a.text = b.text as same
  from (select * from o where chosen) a left join (select * from o where not chosen) b on a.pair_id = b.pair_id and a.i = b.i
), k as (select p.pair_id, coalesce(min(case when not same then i end) - 1, count(m.i)) as n from (select distinct pair_id from o) p left join m on p.pair_id = m.pair_id group by p.pair_id),
x as (
  select o.*, n, {_HEAD} || text || {_TAIL} as turn_text, coalesce(sum(length({_HEAD} || text || {_TAIL})) over (
    partition by o.pair_id, chosen, i > n order by i rows between unbounded preceding and 1 preceding), 0)::bigint as offset_
  from o join k using (pair_id)
)
select pair_id, n as n_prefix_turns, count(*) filter (where {_DONE.format(flag='true')}) as n_chosen_turns, count(*) filter (where {_DONE.format(flag='false')}) as n_rejected_turns,
  {_SIDE.format(what='turn_text', sep='', where='chosen and i <= n')} as prompt,
  {_SIDE.format(what='turn_text', sep='', where=_DONE.format(flag='true'))} as chosen,
  {_SIDE.format(what='turn_text', sep='', where=_DONE.format(flag='false'))} as rejected,
  {_SIDE.format(what=_SPAN, sep=',', where=_DONE.format(flag='true'))} as chosen_mask,
  {_SIDE.format(what=_SPAN, sep=',', where=_DONE.format(flag='false'))} as rejected_mask
from x group by pair_id, n
"""


OP9 = _pairs(_NEIGHBOURS)

_CRC_STEP = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
_HEX = "instr('123456789ABCDEF', substring(x, {at}, 1))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_N = resampling.BUCKETS

OP12 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), b as (select {_WORDS} as w from benchmark),
df as (select r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as f from d),
bf as (select unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as f from b),
crc as (select list({_CRC_STEP} order by i) as t from (select unnest(range(0, 256)) as i)),
x as (select f, hex(encode(f)) as x from (select distinct f from (select f from df union all select f from bf))),
bytes as (select f, list_concat([4294967295], [{_HEX.format(at='2 * i + 1')} * 16 + {_HEX.format(at='2 * i + 2')} for i in range(0, length(x) // 2)]) as c from x),
bucket as (select f, xor(list_reduce(c, lambda a, y: xor(t[(xor(a, y) & 255) + 1], a >> 8)), 4294967295) % {_N} as k from bytes, crc),
s as (select k, count(*) as n from df join bucket using (f) group by k), t as (select k, count(*) as n from bf join bucket using (f) group by k),
gain as (
  select bucket.k, floor(1000 * ln((coalesce(any_value(t.n), 0) + 1)::double * ((select count(*) from df) + {_N})::double / ((coalesce(any_value(s.n), 0) + 1)::double * ((select count(*) from bf) + {_N})::double)))::bigint as g
  from bucket left join s on s.k = bucket.k left join t on t.k = bucket.k group by bucket.k
), sums as (select r, sum(g)::bigint as g, count(*) as n from df join bucket using (f) join gain using (k) group by r),
rows_ as (
  select r, doc_id, len(w) >= {resampling.LEAST_WORDS} as eligible, coalesce(n, 0) as n_features, coalesce((g - (g % n + n) % n) // n, 0) as weight,
    ('0x' || substring(sha256('{resampling.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join sums using (r)
), scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from rows_),
ranked as (select *, case when eligible then row_number() over (partition by eligible order by score desc, doc_id nulls last) end as place from scored)
select doc_id, n_features, weight, score, case when place <= {resampling.PERCENT} * (select count(*) from scored where eligible) // 100 then place end as rank from ranked
"""

_SCORE = "least(coalesce({by} * {a} // nullif({b}, 0), 0), 100000)"
_GRID = ", ".join(f"('{k}', {c})" for k, v in quality.GRID.items() for c in v)
_A = quality.ALPHA / len(quality.GRID)
_CDF = f"""case when k >= {_A} * n then 1 else list_sum(list_transform(range(0, k::bigint + 1), lambda j:
  exp(lgamma(n::double + 1) - lgamma(j::double + 1) - lgamma((n - j)::double + 1) + j * ln({_A}) + (n - j) * ln(1 - {_A})))) end"""

OP10 = f"""
with w as (select row_number() over () as r, doc_id, lang as stratum, coalesce(text, '') as t from documents),
words as (select r, regexp_extract_all(t, '{quality.WORD}') as w from w),
wins as (
  select r, i, array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), ' ') as win
  from (select r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) as i from words where len(w) >= {quality.WINDOW})
), again as (select r, i, lead(i) over (partition by r order by i) as j from (select r, i, count(*) over (partition by r, win) as c from wins) where c > 1),
rep as (select r, sum(least({quality.WINDOW}, coalesce(j - i, {quality.WINDOW}))) as n from again group by r),
lines as (select r, unnest(string_split(t, chr(10))) as l from w),
dup as (select r, count(*) as n, count(*) - count(distinct l) as d from lines where regexp_matches(l, '{quality.WORD}') group by r),
c as (
  select w.r, doc_id, stratum, len(words.w) as n_words, length(array_to_string(words.w, '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_lines, coalesce(dup.d, 0) as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words from w join words using (r) left join rep using (r) left join dup using (r)
), s as (
  select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed,
    {_SCORE.format(by=1000, a='n_symbols', b='word_chars')} as symbols, {_SCORE.format(by=1000, a='n_dup_lines', b='n_lines')} as dup_lines,
    {_SCORE.format(by=1000, a='n_repeat_words', b='n_words')} as repeats, {_SCORE.format(by=10, a='word_chars', b='n_words')} as word_length from c
), good as (select doc_id from labels where doc_id is not null group by doc_id having min(quality) = 1),
bars as (
  unpivot (select stratum, symbols, dup_lines, repeats, word_length from s where not base_failed and doc_id in (select doc_id from good))
  on symbols, dup_lines, repeats, word_length into name rule value score
), tests as (
  select stratum, g.rule, g.cutoff, count(*) as n, count(case when score > cutoff then 1 end) as k
  from bars join (values {_GRID}) g(rule, cutoff) on bars.rule = g.rule group by stratum, g.rule, g.cutoff
), sequences as (select count(*) as m from (select distinct stratum, rule from tests)),
proofs as (select *, {_CDF} <= {quality.DELTA} / m as proved from tests, sequences),
chosen as (select stratum, rule, cutoff from (select *, bool_and(proved) over (partition by stratum, rule order by cutoff desc) as held from proofs) where held),
cut as (select stratum, {', '.join(f"min(case when rule = '{k}' then cutoff end) as max_{k}" for k in quality.GRID)} from chosen group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({' or '.join(f'coalesce({k} > max_{k}, false)' for k in quality.GRID)}) as kept, {', '.join(f'max_{k}' for k in quality.GRID)}
from s left join cut on s.stratum is not distinct from cut.stratum
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1, "op5_url_filter": OP5, "op9_chat_format": OP9, "chat_reanswered": _pairs(_REANSWERED), "op10_quality_rules": OP10, "op12_resampling": OP12}

"""DuckDB SQL for the rows of the queries in :mod:`tidemark.plans.catalog`."""

from __future__ import annotations

_S = """with s as (
  select source || '::' || lang || '/' || doc_id || '.txt' as sample_id, source as grp, cast(substring(source, 4) as int) as idx, lang, doc_id, n_chars,
    case (doc_id // 20) % 10 when 0 then 'val' when 1 then 'test' else 'train' end as split,
    '/data/' || source || '/images/' || lang || '/images/' || doc_id || '.a.jpg' as image_path
  from documents
), arr as (select distinct grp, idx from s), tr as (select * from s where split = 'train')"""
_C = (
    _S
    + """, sizes as (select grp, count(*) as n from tr group by grp),
counts as (
  select t.idx as task, coalesce(sum(z.n), 0)::bigint as candidate_count, coalesce(sum(case when a.idx = t.idx then z.n end), 0)::bigint as current_count
  from arr t join arr a on a.idx <= t.idx left join sizes z on z.grp = a.grp group by t.idx
)"""
)
_M = "with m as (select ((day(ts) - 1) // 6)::int as task, event_type as grp, round(avg(value), 6) as score from events group by 1, 2)"
_NUMBER = "(?i)^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
_SUFFIX = "lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^?#]*', 0), '[^/][.]([^./]+)$', 1))"


def _number(cell: str) -> str:
    plain = f"regexp_replace(trim({cell}), '([0-9])_([0-9])', '\\1\\2', 'g')"
    return f"case when regexp_matches({plain}, '{_NUMBER}') then try_cast({plain} as double) end"


_CELLS = """select event_id, case event_id % 8 when 0 then event_id::varchar when 1 then ' ' || event_id || '.5 ' when 2 then 'x' || event_id when 3 then event_id || '_000'
  when 4 then event_id || 'd' when 5 then '-.5e' || event_id % 9 when 6 then '' else event_id || 'e' end as cell from events"""

def _folded(text: str) -> str:
    """Full case folding by Unicode's table as Python has it."""
    changed = {c: f for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    several = {c: f for c, f in changed.items() if len(f) > 1}
    plain = f"translate({text}, '{''.join(single)}', '{''.join(single.values())}')"
    pairs = f"map([{', '.join(repr(c) for c in several)}], [{', '.join(repr(f) for f in several.values())}])"
    each = f"array_to_string([coalesce({pairs}[c], c) for c in string_split({plain}, '')], '')"
    return f"case when regexp_matches({text}, '[^\\x00-\\x7F]') then {each} else lower({text}) end"


_CLAIMING = f"""with c as (
  select source || '::' || lang || '/' || n_chars as sample_id, cast(substring(source, 4) as int) as idx,
    '/data/images/strasse-' || md5({_folded("coalesce(text, '')")}) || '.jpg' as owner from documents
), k as (select 'id' as kind, sample_id as k, idx, sample_id from c union all select 'owner', owner, idx, sample_id from c)"""
_CLASHES = _CLAIMING + " select kind, k, count(*) as n, arg_min(sample_id, (idx, sample_id)) as first_id from k group by kind, k having count(*) > 1"
#: Of so many sorted ids, those that numpy's default generator draws with seed 56, 20 without replacement, by place.
_DRAWN = [
    (112, [1, 3, 17, 24, 29, 31, 34, 37, 38, 47, 55, 60, 64, 68, 72, 85, 92, 96, 107, 109]),
    (560, [9, 16, 89, 130, 146, 170, 198, 199, 215, 249, 299, 328, 336, 393, 397, 429, 518, 535, 551, 553]),
    (5600, [94, 172, 903, 1317, 1461, 1728, 2010, 2048, 2211, 2521, 3042, 3297, 3393, 3439, 4049, 4053, 4303, 5310, 5478, 5542]),
]
_FOLDED = "['SS', 'ß', 'ẞ', 'ss', 'Σας', 'σασ', 'İ', 'i̇', 'I', 'ﬁ', 'FI', 'Ǆ']"

ORACLES = {
    "registry_counts": _S + " select grp, split, count(*) as n, min(sample_id) as lo, max(sample_id) as hi from s group by grp, split",
    "group_members": _S + " select grp, split, string_agg(sample_id, ',' order by sample_id) as ids from s group by grp, split",
    "relative_path": _S + " select sample_id, 'images/' || lang || '/images/' || doc_id || '.a.jpg' as p from s",
    "label_path": _S + " select sample_id, '/data/' || grp || '/images/' || lang || '/labels/' || doc_id || '.a.txt' as p from s",
    "duplicate_ids": "select user_id as sample_id, count(*) as n from events group by user_id having count(*) > 1",
    "dup_owner_check": f"select sha256({_folded('text')}) as k, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "stream_clashes": _CLASHES,
    "claimed_keys": _CLASHES,
    "stream_accepted": _CLAIMING
    + """ select sample_id, batch from (
  select sample_id, (idx // 5)::int as batch, count(*) over (partition by sample_id order by idx // 5) as ids, count(*) over (partition by owner order by idx // 5) as owners from c
) where ids = 1 and owners = 1""",
    "select_numpy_replay": _S
    + f""", h as (select sample_id, row_number() over (order by sample_id) - 1 as place from tr where idx < 14),
drawn(n, places) as (values {", ".join(str(d) for d in _DRAWN)})
select sample_id, 'replay' as role from h where list_contains((select places from drawn where n = (select count(*) from h)), place)
union all select sample_id, 'current' from tr where idx = 14""",
    "member_chunks": _S
    + """ select grp, split, place // 7 as chunk, min(place) as first, string_agg(sample_id, ',' order by place) as ids, sha256(string_agg(sample_id, chr(10) order by place)) as digest
from (select grp, split, sample_id, row_number() over (partition by grp, split order by sample_id) - 1 as place from s) group by grp, split, place // 7""",
    "path_faults": "select doc_id, case doc_id % 7 when 0 then 'not below the dataset root' when 1 then 'no images directory' else 'no path' end as fault from documents where doc_id % 7 < 3",
    "empty_splits": _S
    + """, g as (select distinct grp || '/' || lang as grp from s)
select g.grp, split from g, (values ('train'), ('val'), ('test')) t(split) where not exists (select 1 from s where s.grp || '/' || s.lang = g.grp and s.split = t.split)""",
    "prediction_table": _S + " select row_number() over (order by sample_id) - 1 as pos, sample_id, reverse(image_path) as prediction from s where split = 'test'",
    "evaluation_table": _S
    + """, g as (select a.grp, count(s.sample_id) as n from arr a left join s on s.grp = a.grp and s.split = 'test' group by a.grp)
select c.checkpoint, grp, round(n / (n + 16.0), 9)::double as map50_95, n as sample_count, round(n / 1000.0, 9)::double as evaluation_seconds from (values ('last'), ('best')) c(checkpoint), g""",
    "owner_fold": f"""select k, count(*) as n, min(event_id) as first_id from (select event_id, {_folded("'/Images/' || user_id || '/' || " + _FOLDED + "[event_id % 12 + 1] || '.JPG'")} as k from events)
group by k having count(*) > 1""",
    "label_schema_check": _S
    + """, n as (select grp, min(idx) as idx, list_sort(list(distinct lang)) as names from s group by grp)
select grp, len(names) as n_names, names = (select arg_min(names, idx) from n) as matches_first from n""",
    "names_normalize": _S + " select grp, string_agg(lang, ',' order by lang) as names from (select distinct grp, lang from s) group by grp",
    "scope_counts": _C + " select task, candidate_count, current_count, candidate_count - current_count as history_count from counts",
    "scope_counts_current": _C + " select task, current_count as candidate_count, current_count, 0::bigint as history_count from counts",
    "scope_roles": _S
    + """ select role, count(*) as n from (
  select case when split = 'train' then 'candidate' when split = 'val' then 'validation' else 'test' end as role from s where idx <= 10
  union all select 'current' from tr where idx = 10 union all select 'history' from tr where idx < 10) group by role""",
    "scope_history_except": _S + " select sample_id from tr where idx <= 10 except select sample_id from tr where idx = 10",
    "scope_test_by_group": _S + " select grp, sample_id from s where split = 'test' and idx <= 5",
    "split_disjoint": "select user_id as sample_id from events where event_type in ('click', 'purchase', 'refund') group by user_id having count(distinct event_type) > 1",
    "current_in_candidate": _S + " select sample_id from tr where idx = 10",
    "missing_ids_anti": "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "labeled_semi": "select doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "select_full": _S + " select t.idx as task, r.sample_id from tr r join arr t on r.idx <= t.idx",
    "select_random_replay": _S
    + """, r as (select sample_id, row_number() over (order by md5('61|' || sample_id), sample_id) as k from tr where idx < 19)
select sample_id, 'current' as role from tr where idx = 19 union all select sample_id, 'replay' from r where k <= 500""",
    "select_current_only": _S + " select sample_id from tr where idx = 10",
    "replay_per_task": _S
    + """ select task, sample_id from (
  select t.idx as task, r.sample_id, row_number() over (partition by t.idx order by md5((42 + t.idx) || '|' || r.sample_id), r.sample_id) as k
  from tr r join arr t on r.idx < t.idx) where k <= 50""",
    "selection_summary": _C
    + """ select task, 'full' as policy, null::bigint as cur, null::bigint as replay, candidate_count as candidate from counts
union all select task, 'random_replay', current_count, least(50, candidate_count - current_count), candidate_count from counts""",
    "manifest_bind": _S + " select row_number() over (partition by grp order by sample_id desc) as pos, sample_id, image_path, n_chars from s where split = 'val'",
    "predict_zip": _S + " select row_number() over (partition by grp order by sample_id) - 1 as pos, sample_id, n_chars * 2 as prediction from s where split = 'test'",
    "override_left_join": "select u.user_id, coalesce(max(e.event_id), 500)::bigint as replay_size from (select distinct user_id from events) u left join events e on e.user_id = u.user_id and e.event_type = 'refund' group by u.user_id",
    "eval_cross": _S + " select c.checkpoint, t.grp, t.n from (values ('last'), ('best')) c(checkpoint), (select grp, count(*) as n from s where split = 'test' group by grp) t",
    "eval_seconds": "select ((day(ts) - 1) // 6)::int as task, sum(case when event_type <> 'click' then (event_id % 7) * 0.5::double else 0 end) as evaluation_seconds from events group by 1",
    "metric_matrix": _M + " select task, grp, score from m",
    "metric_pivot": _M
    + " select task, "
    + ", ".join(f"max(case when grp = '{g}' then score end) as {g}__map50_95" for g in ("click", "purchase", "refund", "signup", "view"))
    + " from m group by task",
    "seen_mean": _M + " select task, round(avg(score), 5) as seen_mean, count(*) as n from m group by task",
    "final_forgetting": _M
    + " select grp, round(max(score) - arg_max(score, task), 6) as forgetting from m group by grp having max(task) = (select max(task) from m)",
    "mean_forgetting": _M
    + """, f as (select max(score) - arg_max(score, task) as v from m group by grp having max(task) = (select max(task) from m))
select round(coalesce(avg(v), 0), 5) as final_mean_forgetting from f""",
    "running_forgetting": _M + " select task, grp, round(max(score) over (partition by grp order by task) - score, 6) as forgetting from m",
    "cost_by_task": _C
    + """ select task as idx, ceil(candidate_count / 16.0)::bigint * 100 as optimizer_steps, candidate_count * 100 as images_read,
  round(task * 0.5::double + candidate_count * 0.25::double, 6) as method_seconds, round((task * 0.5::double + candidate_count * 0.25::double) * 2 / 3600, 6) as gpu_hours
from counts""",
    "device_counts": "select event_id, case event_id % 4 when 2 then 1 when 3 then least(user_id % 4, 3) else 0 end::bigint as n from events",
    "lineage_parent": "select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as parent from conversations",
    "stop_after_failure": """with e as (select event_type as grp, sum(case when event_id % 97 = 96 then 1 else 0 end) over (partition by event_type order by ts, event_id) as bad from events)
select grp, count(*) as n from e where bad = 0 group by grp""",
    "status_latest": "select user_id, arg_max(event_type, (ts, event_id)) as status from events group by user_id",
    "suffix_filter": f"""select suffix, count(*) as n from (select {_SUFFIX} as suffix from pages)
where suffix in ('', 'html', 'com', 'bmp', 'dng', 'heic', 'jpeg', 'jpg', 'mpo', 'pfm', 'png', 'tif', 'tiff', 'webp') group by suffix""",
    "sanitize_names": r"""select url, left(coalesce(nullif(trim(regexp_replace(url, '[<>:"/\\|?*\s]+', '-', 'g'), '-. '), ''), 'run'), 24) as s from pages""",
    "number_parse": f"select event_id, {_number('k')} as k from (select event_id, json_extract_string(props, '$.k') as k from events)",
    "number_cells": f"select event_id, cell, {_number('cell')} as v from ({_CELLS})",
    "arrival_index": _S + " select grp, idx, idx + 42 as seed, printf('%03d', idx) || '__' || grp as task_name from arr",
    "ragged_union": _C
    + """ select task, current_count as current, null::bigint as replay from counts where task < 10
union all select task, current_count, candidate_count - current_count from counts where task >= 10""",
    "config_layers": """select k, v from (
  select event_type || '.' || user_id as k, case when event_id % 5 <> 0 then event_id::varchar end as v, row_number() over (partition by event_type, user_id order by event_id desc) as r from events
) where r = 1""",
    "scope_disjoint": _S + " select count(*) as n from (select sample_id from s group by sample_id having count(distinct split) > 1)",
    "manifest_paths": _S + " select distinct grp || '/images/' || doc_id || '.JPG' as path from s",
    "ordered_lines": _S + " select row_number() over (order by sample_id) - 1 as pos, sample_id from s",
    "history_csv": "select event_id::double as epoch, event_id / 4.0::double as loss, event_type as note from events",
    "ragged_csv": _C + " select task, current_count as current, nullif(candidate_count - current_count, 0) as replay from counts",
    "scope_sink": _S
    + """, r as (
  select 'candidate' as role, grp, sample_id from tr where idx <= 12 union all select 'current', grp, sample_id from tr where idx = 12
  union all select 'history', grp, sample_id from tr where idx < 12
  union all select case split when 'val' then 'validation' else 'test' end, grp, sample_id from s where split <> 'train' and idx <= 12
) select role, grp, count(*) as n, max(sample_id) as hi from r group by role, grp""",
    "selection_sink": _S
    + """, h as (select sample_id from tr where idx < 14 order by md5('56|' || sample_id), sample_id limit 500)
select sample_id, 'replay' as role, 1::bigint as n from h union all select sample_id, 'current', 1::bigint from tr where idx = 14""",
    "arrival_stream": _C + " select task, candidate_count, current_count, candidate_count - current_count as history_count from counts",
    "metric_scores": "select ((day(ts) - 1) // 6)::int as task, event_type as grp, round(avg(value), 6) as score from events where event_id % 2 = 1 group by 1, 2",
}

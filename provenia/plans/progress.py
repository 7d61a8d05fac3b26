"""Queries for the progress of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.plans.registry import query, table
from provenia.streaming import progress

_DOC = "'  [' || (1 + event_id % 4) || '/' || (4 + user_id % 3) || ']'"
#: What runs print: each event is a line of its user's run.
LINE = f"""case event_id % 17
    when 0 then '→ Loading economy config' when 1 then '✓ LLM ready — acme/model-' || user_id % 3 || '  1.' || event_id % 10 || 's'
    when 2 then 'Zone 1 complete — ' || (3 + event_id % 5) || ' documents' when 3 then '→ Fetching — Act ' || event_id || {_DOC}
    when 4 then '✓ Fetched — https://www.acts.org/law/' || event_id || {_DOC} || '  2m 3s' when 5 then '✗ Fetch failed — timeout' || {_DOC}
    when 6 then '  Translating' || {_DOC} when 7 then '✓ RAG retrieval — 15 chunks' || {_DOC} || '  0.' || event_id % 7 || 's'
    when 8 then '✓ LLM extraction — 3 provisions' || {_DOC} when 9 then '✓ Validation — fine' || {_DOC} when 10 then '⚠ Economy config — no portal'
    when 11 then '✓ Economy config — ok  0.2s' when 12 then 'Outputs written — ' || event_id || ' records'
    when 13 then 'Discovery complete — 9 act(s) (' || event_id % 5 || ' KNOWN, ' || user_id % 5 || ' NEW)' when 14 then '→ Zone 1 — portals'
    when 15 then '⚠ Validation — short snippet  3s' else null end"""


def _first(branches: str, otherwise: str = "null") -> str:
    return f"case {branches} else {otherwise} end"


_STAGE = _first(" ".join(f"when contains(t, '{w}') then '{s}'" for w, s in progress.KEYWORDS))
_AT = _first(" ".join(f"when '{s}' then {i}" for i, s in enumerate(progress.STAGES))).replace("case", "case stage", 1)
_KIND = _first(" ".join(f"when starts_with(b, '{m}') then '{k}'" for m, k in progress.MARKS.items()), "'info'")
_IN_LOOP = "(" + ", ".join(f"'{s}'" for s in progress.LOOP) + ")"
_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(progress.STAGES))
SQL = f"""
with l as (select user_id as run, event_id as seq, coalesce({LINE}, '') as t from events),
p as (select *, trim(t) as b, {_STAGE} as stage, nullif(regexp_extract(trim(t), '{progress.ELAPSED}', 1), '') as took, rtrim(regexp_replace(trim(t), '{progress.ELAPSED}', '')) as r from l),
q as (select *, {_KIND} as kind, nullif(regexp_extract(r, '{progress.COUNTER}', 0), '') as c from p),
x as (select *, trim(replace(r, coalesce(c, chr(1)), '')) as bare from q),
y as (select run, seq, t, stage, kind, {_AT} as pos, coalesce(stage in {_IN_LOOP}, false) as loop, case when stage is not null then took end as took,
    case when stage is not null and contains(bare, ' — ') then nullif(trim(substr(bare, instr(bare, ' — ') + 3)), '') end as detail,
    case when stage is not null then try_cast(regexp_extract(c, '{progress.COUNTER}', 1) as int) end as doc, case when stage is not null then try_cast(regexp_extract(c, '{progress.COUNTER}', 2) as int) end as n_of,
    try_cast(regexp_extract(t, '{progress.TOTAL}', 1) as int) as total from x),
z as (select *, coalesce(last_value(case when loop then doc end ignore nulls) over (partition by run order by seq rows between unbounded preceding and 1 preceding), 0) as doc_was from y),
m as (select *, loop and coalesce(doc <> doc_was, false) as change, max(case when total is not null then seq end) over (partition by run order by seq) as total_at from z),
runs as (select run, count(*) as lines, max(case when change then seq end) as reset, arg_max(doc, seq) filter (loop and doc is not null) as current_doc from m group by run),
totals as (select run, max(n) as total_docs from (select run, coalesce(total, n_of, 0) as n, total_at is not distinct from max(total_at) over (partition by run) as own from m) where own group by run),
said as (select run, arg_max(regexp_extract(t, '{progress.RECORDS}', 1), seq) filter (regexp_matches(t, '{progress.RECORDS}')) as records,
    arg_max(regexp_extract(t, '{progress.ACTS}', 1), seq) filter (regexp_matches(t, '{progress.ACTS}')) as acts_total, arg_max(regexp_extract(t, '{progress.ACTS}', 2), seq) filter (regexp_matches(t, '{progress.ACTS}')) as acts_known,
    arg_max(regexp_extract(t, '{progress.ACTS}', 3), seq) filter (regexp_matches(t, '{progress.ACTS}')) as acts_new, arg_max(regexp_extract(t, '{progress.PROVIDER}', 1), seq) filter (regexp_matches(t, '{progress.PROVIDER}')) as provider from m group by run),
base as (select run, stage, pos, loop, max(seq) filter (loop or kind <> 'warn') as since, arg_max(kind, seq) filter (loop or kind <> 'warn') as kind from m where stage is not null group by all),
stage_runs as (select r.run, s.stage, s.pos, s.stage in {_IN_LOOP} as loop, r.reset, b.since, b.kind from runs r, (values {_VALUES}) s(pos, stage) left join base b on b.run = r.run and b.stage = s.stage),
warned as (select b.run, b.stage, min(w.seq) as at_seq from stage_runs b join m w on w.run = b.run and w.stage = b.stage and w.kind = 'warn' and w.seq > coalesce(b.since, -1) where not b.loop group by all),
plain as (select *, case when kind in ('start', 'info') then 'running' else kind end as said_status, case when loop and reset is not null and coalesce(since < reset, true) then 'pending' when loop and kind = 'fail' then 'warn' when kind in ('start', 'info') then 'running' else kind end as base from stage_runs),
after as (select p.*, w.at_seq as warn_seq,
    exists (select 1 from m where m.run = p.run and m.loop and m.pos > p.pos and m.seq > case when p.base = 'pending' then p.reset - 1 else coalesce(p.since, -1) end) as loop_after,
    exists (select 1 from m where m.run = p.run and not m.loop and m.pos > p.pos and m.seq > case when p.base = 'pending' then p.reset - 1 else coalesce(p.since, -1) end) as once_after,
    exists (select 1 from m where m.run = p.run and not m.loop and m.pos > p.pos and m.seq > p.since and m.seq < w.at_seq) as once_between
    from plain p left join warned w on w.run = p.run and w.stage = p.stage),
stage_state as (select run, stage, loop, reset, case
    when loop then case when coalesce(base, 'pending') in ('pending', 'running') and loop_after then 'done' when base = 'running' and once_after then 'done' else base end
    when warn_seq is not null then case when said_status = 'done' or said_status = 'running' and once_between then 'done' else 'warn' end
    when said_status = 'running' and once_after then 'done' else said_status end as status from after),
notes as (select s.run, s.stage, arg_max(detail, seq) filter (detail is not null) as detail, arg_max(took, seq) filter (took is not null) as took
    from stage_state s join m on m.run = s.run and m.stage = s.stage and not m.change and (not s.loop or s.reset is null or m.seq > s.reset) group by all),
docs as (select run, doc, min(seq) as first, max(case when change then seq end) as came, arg_max(stage, seq) as stage,
    arg_max(case when kind = 'fail' then 'warn' else 'done' end, seq) filter (kind = 'fail' or stage = 'validate' and kind = 'done') as told,
    arg_max(detail, seq) filter (stage = 'fetch' and kind in ('start', 'done') and detail is not null) as title from m where loop and doc is not null group by all),
counters as (unpivot (select run, lines::varchar as lines, total_docs::varchar as total_docs, coalesce(current_doc, 0)::varchar as current_doc, records, acts_total, acts_known, acts_new, provider
    from runs join totals using (run) join said using (run)) on columns(* exclude run) into name name value detail)
select run, 'stage' as item, s.stage as name, status, null as stage, left(detail, {progress.NOTE}) as detail, took as "time" from stage_state s left join notes n using (run, stage) where status is not null
union all select run, 'document', doc::varchar, coalesce(told, case when exists (select 1 from docs e where e.run = d.run and e.doc > d.doc and e.came > d.first) then 'done' else 'running' end), stage,
    coalesce(case when starts_with(title, 'http') then regexp_replace(title, '^https?://(?:www.)?([^/]*)/.*/([^/]*)$', '\\1/\\2') else title end, ''), null from docs d
union all select run, 'counter', name, null, null, detail, null from counters
"""


@query(SQL)
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """Stages, documents and counters of runs, from the lines that they print."""
    lines = table(spark, d, "events", "user_id", "event_id").select("user_id", "event_id", F.expr(LINE).alias("line"))
    return progress.progress(lines, "user_id", "event_id", "line")

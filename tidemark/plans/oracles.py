"""The queries of ``queries`` as DuckDB SQL."""

from __future__ import annotations

from .queries import INTERVALS, OFF_TIES

ORACLE: dict[str, str] = {}


def r6(x: str) -> str:
    return f"round({x} + {OFF_TIES}, 6) + 0.0"


EV = """ev as (
    select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as row_idx, epoch_us(ts) / 1e6 as t,
        value, event_type, event_id, case event_type when 'error' then 1 when 'signup' then -1 else 0 end as label from events)"""
GAPPY = "gappy as (select * replace (case when event_id % 17 = 0 then null else value end as value) from ev)"
HOURS = """hours as (
    select list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as channel, floor(epoch_us(ts) / 1e6 / 3600) * 3600 as bin,
        avg(value) as value, count(*) as n from events group by 1, 2),
hrows as (select *, row_number() over (partition by channel order by bin) - 1 as row_idx from hours)"""
EMB = "emb as (select label as series_id, vec_id as row_idx, unnest(range(len(embedding))) as channel, cast(unnest(embedding) as double) as value from embeddings)"
DAYS = """dsum as (
    select l_returnflag as series_id, floor(epoch_us(l_shipdate) / 1e6 / 86400) * 86400 as t, sum(l_quantity) as value, count(*) as n from lineitem group by 1, 2),
days as (
    select *, row_number() over (partition by series_id order by t) - 1 as row_idx, case when n % 7 = 0 then 1 when n % 5 = 0 then -1 else 0 end as label from dsum)"""


def scaled(src: str, keys: str, name: str = "z", where: str = "true") -> str:
    """Robust z-scores of ``src``: CTEs that end in ``name``."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_c as (select {keys}, median(value) as centre, stddev_pop(value) as sd from {src} where {where} group by {keys}),
{name}_m as (select {", ".join("a." + k for k in keys.split(", "))}, any_value(centre) as centre, any_value(sd) as sd, median(abs(value - centre)) * 1.4826 as mad
    from (select * from {src} where {where}) a join {name}_c b on {on} group by {", ".join("a." + k for k in keys.split(", "))}),
{name} as (select a.*, b.centre, case when mad > 1e-8 then mad when sd > 1e-8 then sd else 1 end as scale,
    greatest(-50, least(50, (value - centre) / (case when mad > 1e-8 then mad when sd > 1e-8 then sd else 1 end))) as z from {src} a join {name}_m b on {on})"""


SCORES = f"""{EV}, {scaled("ev", "series_id")}, sc as (select series_id, row_idx, label, round(1 - exp(-abs(z)), 6) as score from z)"""
CURVE = """one as (select series_id, score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from {src} where label >= 0 group by 1, 2),
curve as (select *, sum(pos) over d as tp, sum(neg) over d as fp, sum(pos) over e as p, sum(neg) over e as n from one
    window d as (partition by series_id order by score desc rows between unbounded preceding and current row), e as (partition by series_id))"""
RANKED = f"""{SCORES}, {CURVE.format(src="sc")}, ranked as (
    select series_id, sum(pos / p * tp / (tp + fp)) as average_precision, sum(pos * (n - fp + neg / 2) / (p * n)) as roc_auc, max(2 * tp / (tp + fp + p)) as best_f1
    from curve where p > 0 and n > 0 group by 1)"""
ISLANDS = "isl as (select *, row_idx - row_number() over (partition by series_id order by row_idx) as run from {src} where label = {label})"
RUNS = ISLANDS + ", runs as (select series_id, min(row_idx) as start, max(row_idx) + 1 as stop, max(row_idx) + 1 - min(row_idx) as length from isl group by series_id, run)"

ORACLE["robust_zscore_flags"] = f"with {EV}, {scaled('ev', 'series_id')} select series_id, count(*) as n_flags, {r6('max(abs(z))')} as max_z from z where abs(z) > 3 group by 1"
ORACLE["series_catalog"] = f"""with {EV}, s as (select *, t - lag(t) over (partition by series_id order by row_idx) as step from ev)
select series_id, count(*) as n_rows, cast(1 as bigint) as n_channels, {r6("coalesce(median(step), 1)")} as step_s, {r6("count(*) filter (label = 1) / count(*)")} as anomaly_row_ratio,
    min(case when label = -1 then 1 else 0 end) as unlabeled from s group by 1"""
ORACLE["delta_t_feature"] = f"""with {EV}, s as (select *, t - lag(t) over (partition by series_id order by row_idx) as step from ev)
select series_id, row_idx, {r6("coalesce(ln(1 + step / greatest(median(step) over (partition by series_id), 1e-12)), 0)")} as delta_t from s"""
ORACLE["fill_forward_backmedian"] = f"""with {EV}, {GAPPY}, f as (
    select *, last_value(value ignore nulls) over (partition by series_id order by row_idx rows between unbounded preceding and current row) as ff from gappy)
select series_id, row_idx, {r6("coalesce(ff, median(ff) over (partition by series_id), 0)")} as filled from f"""
ORACLE["robust_normalize"] = f"with {EMB}, {scaled('emb', 'series_id, channel')} select series_id, row_idx, channel, {r6('z')} as z from z"
ORACLE["robust_normalize_ref"] = f"with {EV}, {scaled('ev', 'series_id', where='row_idx < 20')} select series_id, row_idx, {r6('z')} as z from z"
_AROUND = "value - avg(value) over (partition by channel order by row_idx rows between {a} preceding and {b} following)"
ORACLE["diff_ms8"] = f"""with {HOURS} select channel, row_idx, {r6("coalesce(value - lag(value) over (partition by channel order by row_idx), 0)")} as diff, {r6(_AROUND.format(a=4, b=3))} as ms8 from hrows"""
ORACLE["ms64"] = f"with {HOURS} select channel, row_idx, {r6(_AROUND.format(a=32, b=31))} as ms64 from hrows"
ORACLE["label_runs"] = f"with {EV}, {RUNS.format(src='ev', label=1)} select * from runs"
ORACLE["label_onset_cut"] = f"""with {EV}, {RUNS.format(src="ev", label=1)}
select e.series_id, e.row_idx, case when e.row_idx - r.start >= 1 then -1 else e.label end as label from ev e left join runs r on r.series_id = e.series_id and e.row_idx >= r.start and e.row_idx < r.stop"""
ORACLE["label_context_fix"] = f"""with {EV}, {RUNS.format(src="ev", label=1)},
cut as (select e.series_id, e.row_idx, r.start, case when e.row_idx - r.start >= 2 then -1 else e.label end as label
    from ev e left join runs r on r.series_id = e.series_id and e.row_idx >= r.start and e.row_idx < r.stop),
ctx as (select *, sum(case when label = 0 then 1 else 0 end) over (partition by series_id order by row_idx rows between unbounded preceding and current row) as normal, count(*) over (partition by series_id) as n from cut)
select series_id, row_idx, case when label = 1 and normal < least(6, floor(n / 10)) then -1 else label end as label from ctx"""
ORACLE["normal_reference"] = f"""with {EV}, {RUNS.format(src="ev", label=0)}, k as (select *, row_number() over (partition by series_id order by start desc) as k from runs where length >= 4)
select series_id, greatest(start, stop - 6) as start, stop from k where k = 1"""
ORACLE["row_targets"] = f"""with {HOURS}, c as (select bin, case when n % 4 = 0 then 1 when n % 5 = 0 then -1 else 0 end as label from hours)
select bin, case when bool_or(label = 1) then 1 when bool_and(label = 0) then 0 else -1 end as label from c group by 1"""
ORACLE["supervision_weights"] = """with c as (
    select d.doc_id, coalesce(l.toxic, -1) as label, d.doc_id % 2 = 0 as by_row, case d.doc_id % 3 when 0 then 0.2 when 1 then 0.3 else 1.0 end as conf from documents d left join labels l on l.doc_id = d.doc_id)
select doc_id, cast(case when by_row and label = 1 then -1 when label >= 0 then label else 0 end as int) as target,
    cast(case when by_row and label = 1 then 0 when label >= 0 then conf else 0.05 end as double) as weight, cast(case when by_row and label = 1 then conf else 0 end as double) as row_weight from c"""
_AUDIT = f"""{EV}, {RUNS.format(src="ev", label=1)}, f as (select *, min(case when label = 1 then row_idx end) over (partition by series_id) as first from ev),
base as (select series_id, count(*) as n, count(*) filter (label >= 0) as known, count(*) filter (label = 1) as positive, count(*) filter (label = 0 and (first is null or row_idx < first)) as context from f group by 1),
evs as (select series_id, count(*) as events, max(length) as longest from runs group by 1),
j as (select b.*, coalesce(events, 0) as events, coalesce(longest, 0) as longest, case when known > 0 then positive / known end as ratio from base b left join evs e on e.series_id = b.series_id),
audit as (select series_id, n, known, ratio, events, longest, context, coalesce(ratio > 0.2, false) as flag_ratio, longest > 3 as flag_long, events > 0 and context < least(6, floor(n / 10)) as flag_context from j)"""
ORACLE["label_audit"] = f"with {_AUDIT} select * replace (round(ratio, 6) as ratio), flag_ratio or flag_long or flag_context as flag from audit"
ORACLE["label_audit_summary"] = f"""with {_AUDIT} select series_id % 7 as grp, count(*) as series, count(*) filter (flag_ratio or flag_long or flag_context) as flagged, round(median(ratio), 6) as median_ratio, max(longest) as longest
from audit group by 1 having flagged > 0"""
ORACLE["role_assignment"] = f"""with {EV}, c as (
    select series_id, 3 * count(*) filter (label = 1) / count(*) as ratio, series_id % 9 as s, series_id % 4 as k, series_id % 3 = 0 as unlabeled, series_id % 13 = 0 as bench, series_id % 5 = 0 as is_val from ev group by 1),
r as (select *, case when bench then 'benchmark' when s in (1, 2) and not unlabeled then 'test' when s = 3 and not unlabeled then 'val' when s in (1, 2, 3) then 'holdout'
    when is_val and not unlabeled then 'val' when k = 3 then 'holdout' else 'train' end as role from c)
select series_id, case when role in ('val', 'test') and ratio > 0.5 then 'holdout' else role end as role from r"""
_DAILY = "bins as (select series_id, floor(t / 86400) * 86400 as bin, avg(value) as value, count(*) as n from ev group by 1, 2)"
ORACLE["resample_mean"] = f"with {EV}, {_DAILY} select series_id, bin, {r6('value')} as value, n from bins"
ORACLE["gap_fill_grid"] = f"""with {EV}, {_DAILY}, g as (select series_id, cast(unnest(generate_series(cast(min(bin) as bigint), cast(max(bin) as bigint), 86400)) as double) as bin from bins group by 1)
select g.series_id, g.bin, {r6("coalesce(value, 0)")} as value from g left join bins b on b.series_id = g.series_id and b.bin = g.bin"""
_BLOCKS = """w{f} as (select *, floor(count(*) over (partition by series_id) / {f}) * {f} as whole from {src}),
b{f} as (select series_id, cast(floor(row_idx / {f}) as bigint) as row_idx, min(t) as t, avg(value) as value, case when bool_or(label = 1) then 1 when bool_and(label = 0) then 0 else -1 end as label
    from w{f} where row_idx < whole group by 1, 2)"""
ORACLE["block_downsample"] = f"with {DAYS}, {_BLOCKS.format(f=4, src='days')} select series_id, row_idx, t as timestamp, {r6('value')} as value, label from b4"
_VALUES = ", ".join(f"({s}, {a}, {'null' if b is None else b}, {y})" for s, a, b, y in INTERVALS)
ORACLE["interval_label"] = f"""with {EV}, iv(s, a, b, y) as (values {_VALUES})
select series_id, row_idx, coalesce((select case max(case y when 1 then 2 when -1 then 1 else 0 end) when 2 then 1 when 1 then -1 else 0 end from iv where s = series_id and t >= a and (b is null or t <= b)), 0) as label from ev"""
ORACLE["asof_align"] = f"""with {EV}, l as (select * from ev where event_type = 'click'), r as (select series_id, t, value from ev where event_type = 'view')
select l.event_id, l.series_id, {r6("r.value")} as last_view from l asof left join r on l.series_id = r.series_id and l.t >= r.t"""
ORACLE["dup_timestamp_merge"] = f"""with {EV}, {GAPPY}, m as (select series_id, floor(t / 43200) * 43200 as timestamp, avg(value) as value, count(*) as n_merged from gappy group by 1, 2)
select series_id, row_number() over (partition by series_id order by timestamp) - 1 as row_idx, timestamp, {r6("value")} as value, n_merged from m"""
ORACLE["sliding_window_blend"] = f"""with {DAYS}, len as (select series_id, count(*) as m from days group by 1),
st as (select series_id, m, unnest(list_distinct(list_concat(case when m > 256 then range(0, m - 256 + 1, 128) else [0] end, case when m > 256 then [m - 256] else [0] end))) as start from len),
w as (select d.series_id, d.row_idx, (d.value + start) / 1000 as score, (1 - abs(case when least(256, m) > 1 then 2 * (row_idx - start) / (least(256, m) - 1) - 1 else -1 end)) * 0.9 + 0.1 as w
    from days d join st s on s.series_id = d.series_id and row_idx >= start and row_idx < start + 256)
select series_id, row_idx, {r6("sum(score * w) / greatest(sum(w), 1e-8)")} as score, count(*) as n_windows from w group by 1, 2"""
_P = f"{EMB}, {scaled('emb', 'series_id, channel')}, p as (select row_idx, round(1 - exp(-abs(z)), 9) as p from z), l as (select row_idx, list_sort(list(p), 'DESC')[1:3] as top, max(p) as most from p group by 1)"
ORACLE["row_score_topk"] = f"with {_P} select row_idx, {r6('list_sum(top) / len(top)')} as score from l"
ORACLE["row_score_max"] = f"with {_P} select row_idx, {r6('most')} as score from l"
ORACLE["row_score_noisy_or"] = f"with {_P} select row_idx, {r6('1 - (1 - least(top[1], 1 - 1e-6)) * (1 - least(top[2], 1 - 1e-6)) * (1 - least(top[3], 1 - 1e-6))')} as score from l"
ORACLE["combine_scales"] = f"""with {DAYS}, pd as (select series_id, row_idx, t, label, round(value / (value + 500), 9) as value from days),
{_BLOCKS.format(f=2, src="pd")}, {_BLOCKS.format(f=4, src="pd")},
l2 as (select series_id, max(row_idx) as last from b2 group by 1), l4 as (select series_id, max(row_idx) as last from b4 group by 1),
m as (select d.*, least(cast(floor(d.row_idx / 2) as bigint), l2.last) as r2, least(cast(floor(d.row_idx / 4) as bigint), l4.last) as r4 from pd d join l2 on l2.series_id = d.series_id join l4 on l4.series_id = d.series_id),
j as (select m.series_id, m.row_idx, m.value as p, b2.value as p2, b4.value as p4 from m join b2 on b2.series_id = m.series_id and b2.row_idx = r2 join b4 on b4.series_id = m.series_id and b4.row_idx = r4)
select series_id, row_idx, {r6("greatest(p, p2, p4)")} as c_max, {r6("(p + p2 + p4) / 3")} as c_equal, {r6("((p + p2) / 2 + p4) / 2")} as c_mean from j"""
ORACLE["calibrate_rows"] = f"""with {SCORES}, c as (select series_id, row_idx, greatest(1e-7, least(1 - 1e-7, score)) as q from sc)
select series_id, row_idx, {r6("1 / (1 + exp(-greatest(-60, least(60, ln(q / (1 - q)) / 2 - 0.5))))")} as p from c"""
ORACLE["detect_short_series"] = f"""with {EV}, sh as (select * from ev where series_id in (select series_id from ev group by 1 having count(*) < 66)), {scaled("sh", "series_id")},
q as (select series_id, least(1, greatest(0, 1 - exp(-greatest(abs(z) - 3, 0)))) as p from z)
select series_id, count(*) as n, count(*) filter (p > 0.75) as n_low, count(*) filter (p > 0.5) as n_medium, count(*) filter (p > 0.3) as n_high, {r6("max(p)")} as max_p from q group by 1"""
ORACLE["detect_events"] = f"""with {HOURS}, {scaled("hours", "channel")},
c as (select cast(bin as bigint) as t, cast(bin / 3600 - 473352 as bigint) as row_idx, channel, round(1 - exp(-abs(z) / 2), 9) as p, channel % 3 + 1 as type from z),
rs as (select row_idx, list_sort(list(p), 'DESC')[1:3] as top from c group by 1), sc as (select 0 as series_id, row_idx, list_sum(top) / len(top) as score from rs),
fl as (select *, case when score > 0.6 then 1 else 0 end as label from sc), {ISLANDS.format(src="fl", label=1)},
x as (select c.*, run, score, p > 0.6 as over_, p = max(p) over (partition by c.row_idx) as strongest from c join isl i on i.row_idx = c.row_idx),
y as (select *, case when bool_or(over_) over (partition by run) then over_ else strongest end as used from x),
k as (select run, type, count(*) as n from y where used group by 1, 2), kk as (select run, type, row_number() over (partition by run order by n desc, type) as k from k),
e as (select run, min(row_idx) as start, max(row_idx) as stop, min(t) as start_time, max(t) as stop_time, list_sort(list_distinct(list(channel) filter (used))) as ch, max(score) as conf from y group by 1)
select 0 as series_id, start, stop, start_time, stop_time, (['spike', 'level_shift', 'flatline'])[type] as type, array_to_string(ch, ',') as channels, {r6("conf")} as confidence,
    len(ch) || ' channels deviate over ' || (stop - start + 1) || ' rows' as reason from e join kk on kk.run = e.run and kk.k = 1"""
_WIDE = f"""{DAYS}, lab as (select series_id, row_idx, value, case when row_idx % 90 >= 60 and row_idx % 90 < 72 then 1 else 0 end as label from days),
cells as (select series_id, row_idx, label, 0 as channel, case when label = 1 then value * 3 else value end as value from lab union all select series_id, row_idx, label, 1, value + row_idx % 5 from lab)"""
_STATS = f"""{_WIDE}, {RUNS.format(src="lab", label=1)}, len as (select series_id, count(*) as n from lab group by 1),
es as (select r.*, n, greatest(0, start - greatest(32, 2 * length)) as low, least(n, stop + 2 * length) as high from runs r join len l on l.series_id = r.series_id where length <= 4096),
ev2 as (select * from es where start - low >= 16),
near as (select c.series_id, c.row_idx, channel, value, start, stop, length, n, case when row_idx < start then 'pre' when row_idx < stop then 'event' else 'post' end as phase
    from cells c join ev2 e on e.series_id = c.series_id and row_idx >= low and row_idx < high),
cen as (select series_id, start, channel, any_value(stop) as stop, any_value(length) as length, any_value(n) as n, median(value) filter (phase = 'pre') as m0, median(value) filter (phase = 'event') as me,
    median(value) filter (phase = 'post') as mp, count(value) filter (phase = 'pre') as n_pre, count(value) filter (phase = 'event') as n_event, count(*) filter (phase = 'post') as n_post from near group by 1, 2, 3),
spr as (select c.*, s.sd0, s.sde from cen c join (select n.series_id, n.start, n.channel, median(abs(value - m0)) filter (phase = 'pre') * 1.4826 + 1e-9 as sd0, median(abs(value - me)) filter (phase = 'event') * 1.4826 + 1e-9 as sde
    from near n join cen c on c.series_id = n.series_id and c.start = n.start and c.channel = n.channel group by 1, 2, 3) s on s.series_id = c.series_id and s.start = c.start and s.channel = c.channel where n_pre >= 4),
ins as (select s.series_id, s.start, s.channel, s.length, row_idx, abs((value - m0) / sd0) as d from near n join spr s on s.series_id = n.series_id and s.start = n.start and s.channel = n.channel where phase = 'event'),
amp as (select series_id, start, channel, median(d) as a from ins group by 1, 2, 3),
ons as (select i.series_id, i.start, i.channel, min(row_idx - i.start) / any_value(length) as onset from ins i join amp a on a.series_id = i.series_id and a.start = i.start and a.channel = i.channel where a > 0.5 and d >= a / 2 group by 1, 2, 3),
per as (select s.*, a.a, o.onset, case when n_event >= 4 then sde / sd0 end as vr, case when n_post >= 8 then case when abs(mp - m0) / sd0 < 1 then 1.0 else 0.0 end end as ret
    from spr s join amp a on a.series_id = s.series_id and a.start = s.start and a.channel = s.channel left join ons o on o.series_id = s.series_id and o.start = s.start and o.channel = s.channel),
stats as (select series_id, start, any_value(length) as duration, any_value(length) / 4096 as duration_share, count(*) filter (a >= 0.5) as n_affected, count(*) filter (a >= 0.5) / count(*) as affected_share,
    coalesce(median(a) filter (a >= 0.5), median(a)) as amplitude, median(onset) as onset, any_value(stop) >= any_value(n) - 1 as persists, avg(ret) as return_share, median(vr) as variance_ratio from per group by 1, 2)"""
ORACLE["event_statistics"] = f"""with {_STATS} select series_id, start, duration, {r6("duration_share")} as duration_share, n_affected, {r6("affected_share")} as affected_share, {r6("amplitude")} as amplitude,
{r6("onset")} as onset, persists, {r6("return_share")} as return_share, {r6("variance_ratio")} as variance_ratio from stats"""
ORACLE["event_summary"] = f"""with {_STATS} select series_id, count(*) as events, round(quantile_cont(duration, 0.1), 2) as d1, round(quantile_cont(duration, 0.5), 2) as d2, round(quantile_cont(duration, 0.9), 2) as d3,
{r6("avg(persists::int)")} as persists, {r6("avg((variance_ratio < 0.5)::int)")} as calms from stats group by 1"""
ORACLE["template_bank"] = f"""with {_STATS}, u as (select series_id, start, duration as length from stats where duration between 8 and 2048 and amplitude >= 0.5),
nr as (select c.series_id, u.start, channel, u.length, row_idx, value from cells c join u on u.series_id = c.series_id and row_idx >= u.start - 2 * u.length and row_idx < u.start + 3 * u.length),
c0 as (select series_id, start, channel, median(value) filter (row_idx < start) as m0 from nr group by 1, 2, 3),
c1 as (select n.series_id, n.start, n.channel, any_value(m0) as m0, median(abs(value - m0)) filter (row_idx < n.start) * 1.4826 + 1e-9 as sd0 from nr n join c0 c on c.series_id = n.series_id and c.start = n.start and c.channel = n.channel group by 1, 2, 3),
zz as (select n.*, greatest(-30, least(30, (value - m0) / sd0)) as z from nr n join c1 c on c.series_id = n.series_id and c.start = n.start and c.channel = n.channel where sd0 > 1e-8),
af as (select series_id, start, channel from zz where row_idx >= start and row_idx < start + length group by 1, 2, 3 having median(abs(z)) >= 0.5)
select z.series_id, z.start, z.channel, row_idx - z.start as place, {r6("z")} as z from zz z join af a on a.series_id = z.series_id and a.start = z.start and a.channel = z.channel"""
for _name in ("average_precision", "roc_auc", "best_f1"):
    ORACLE[_name] = f"with {RANKED} select series_id, {r6(_name)} as {_name} from ranked"
_LOSS = "-(label * ln(greatest(1e-7, least(1 - 1e-7, score))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, score))))"
ORACLE["brier_nll"] = f"""with {SCORES} select series_id, count(*) as n, {r6("avg(label)")} as anomaly_share, {r6("avg((score - label) ** 2)")} as brier, {r6(f"avg({_LOSS})")} as nll from sc where label >= 0 group by 1"""


def _vus(buffers: tuple[int, ...]) -> str:
    wide = " union all ".join(f"select series_id, {b} as buffer, score, max(label) over (partition by series_id order by row_idx rows between {b} preceding and {b} following) as label from known" for b in buffers)
    return f"""known as (select * from sc where label >= 0), wide as ({wide}),
v1 as (select series_id, buffer, score, count(*) filter (label = 1) as pos, count(*) as m from wide group by 1, 2, 3),
v2 as (select *, sum(pos) over d as tp, sum(m) over d as seen, sum(pos) over (partition by series_id, buffer) as p from v1 window d as (partition by series_id, buffer order by score desc rows between unbounded preceding and current row)),
v3 as (select series_id, buffer, sum(pos / p * tp / seen) as ap from v2 where p > 0 group by 1, 2), two as (select series_id from known group by 1 having min(label) < max(label)),
vus as (select series_id, avg(ap) as vus_pr from v3 where series_id in (select series_id from two) group by 1)"""


ORACLE["vus_pr"] = f"with {SCORES}, {_vus((0, 2, 5, 9))} select series_id, {r6('vus_pr')} as vus_pr from vus"
ORACLE["row_metrics"] = f"""with {RANKED}, {_vus((0, 16, 64, 256))},
b as (select series_id, count(*) as n, avg(label) as anomaly_share, avg((score - label) ** 2) as brier, avg({_LOSS}) as nll from sc where label >= 0 group by 1)
select b.series_id, b.n, {", ".join(f"{r6(c)} as {c}" for c in ("anomaly_share", "brier", "nll", "average_precision", "roc_auc", "best_f1", "vus_pr"))}
from b left join ranked r on r.series_id = b.series_id left join vus v on v.series_id = b.series_id"""
ORACLE["source_score"] = f"""with {RANKED}, s as (select series_id % 9 as source, series_id % 9 < 3 as unseen, avg((average_precision + roc_auc) / 2) as s from ranked group by 1, 2),
t as (select avg(s) filter (unseen) as u, avg(s) filter (not unseen) as k from s)
select {r6("u")} as unseen_score, {r6("k")} as seen_score, {r6("coalesce(0.7 * u + 0.3 * k, u, k)")} as score from t"""
ORACLE["threshold_bestf1"] = f"""with {SCORES}, {CURVE.format(src="sc")}, f as (select *, round(2 * tp / (tp + fp + p), 9) as f1 from curve where p > 0),
k as (select *, row_number() over (partition by series_id order by f1 desc, score desc) as k from f) select series_id, {r6("greatest(1e-4, least(0.95, score))")} as threshold, {r6("f1")} as f1 from k where k = 1"""
ORACLE["column_volatility_topk"] = f"""with {EMB}, v as (select series_id, channel, {r6("stddev_samp(value) / (median(abs(value)) + 1e-9)")} as volatility from emb group by 1, 2),
k as (select *, row_number() over (partition by series_id order by volatility desc, channel) as place from v) select * from k where place <= 8"""
ORACLE["constant_column_filter"] = f"""with {EV}, w as (select series_id, 0 as channel, value from ev union all select series_id, 1, case when event_id % 3 = 0 then value end from ev union all select series_id, 2, 5.0 from ev)
select series_id, channel, {r6("count(value) / count(*)")} as known, {r6("stddev_samp(value)")} as sd from w group by 1, 2 having count(value) / count(*) > 0.5 and stddev_samp(value) > 0"""
ORACLE["corr_partner"] = f"""with {HOURS}, p as (select a.channel, b.channel as partner, corr(a.n, b.n) as r from hours a join hours b on a.bin = b.bin and a.channel <> b.channel group by 1, 2),
k as (select *, row_number() over (partition by channel order by round(abs(r), 9) desc, partner) as k from p) select channel, partner, {r6("r")} as r from k where k = 1"""
ORACLE["melt_pivot_last"] = f"""with {EV}, l as (select *, floor(t / 86400) * 86400 as bin, row_number() over (partition by series_id, floor(t / 86400), event_type order by t desc, event_id desc) as k from ev where event_type in ('click', 'error', 'view'))
select series_id, bin, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'error') as error, max(value) filter (event_type = 'view') as view from l where k = 1 group by 1, 2"""
ORACLE["catalog_upsert"] = """with n as (select distinct o_custkey as id from orders where o_orderpriority = '1-URGENT')
select id, 'new' as state from n union all select c_custkey, 'old' from customer where c_custkey not in (select id from n)"""
ORACLE["holdout_split"] = "select o_custkey % 5 = 0 as held, count(*) as n, count(distinct o_custkey) as customers from orders group by 1"
_INJECT = {
    "inject_spike": ("spike", "row_idx = 14", "value + 4 * scale"),
    "inject_level": ("level_shift", "row_idx >= 10 and row_idx < 18", "value + 4 * scale"),
    "inject_flatline": ("flatline", "row_idx >= 10 and row_idx < 18", "coalesce(held, value)"),
    "inject_correlation_break": ("correlation_break", "row_idx >= 10 and row_idx < 18", "coalesce(elsewhere, value)"),
    "inject_drift": ("drift", "row_idx >= 10 and row_idx < 18", "value + 4 * scale * ((row_idx - 9) / 8) * ((row_idx - 9) / 8)"),
}
for _name, (_kind, _hit, _new) in _INJECT.items():
    _id = {"spike": 1, "level_shift": 2, "flatline": 3, "drift": 4, "correlation_break": 7}[_kind]
    ORACLE[_name] = f"""with {EV}, {scaled("ev", "series_id")}, h as (select series_id, value as held from ev where row_idx = 10),
m as (select z.series_id, row_idx, value, {_hit} as hit, case when {_hit} then {_new} else value end as new, scale from z left join h on h.series_id = z.series_id
    left join (select series_id as s, row_idx + 8 as at, value as elsewhere from ev where row_idx between 2 and 9) f on f.s = z.series_id and f.at = row_idx),
e as (select series_id, coalesce(avg(case when hit then abs(new - value) / scale end) >= 0.3, false) as ok from m group by 1)
select m.series_id, row_idx, {r6("case when hit and ok then new else value end")} as value, case when hit and ok then 1 else 0 end as label, case when hit and ok then {_id} else 0 end as type from m join e on e.series_id = m.series_id"""
ORACLE["budget_select"] = """with o as (select o_orderpriority, o_orderkey, cast(floor(o_totalprice) as bigint) as size from orders),
r as (select *, sum(size) over w as running, row_number() over w as k from o window w as (partition by o_orderpriority order by o_orderkey rows between unbounded preceding and current row))
select o_orderpriority, o_orderkey, cast(running as bigint) as running from r where running <= 5000000 or k = 1"""
ORACLE["snapshot_features"] = f"""with s as (select l_returnflag as series_id, l_quantity as x, avg(l_quantity) over (partition by l_returnflag) as m from lineitem)
select series_id, {r6("sqrt(avg(x * x))")} as rms, max(abs(x)) as peak, {r6("avg((x - m) ** 4) / (avg((x - m) ** 2) ** 2 + 1e-12)")} as kurtosis from s group by 1"""
ORACLE["seasonal_features"] = f"""with {EV}, h as (select *, (t - floor(t / 86400) * 86400) / 3600 as hour from ev)
select event_id, {r6("hour")} as hour, cast((floor(t / 86400) + 3) % 7 as int) as weekday, {r6("(t / 86400 - floor(t / 86400 / 365.25) * 365.25) / 365.25")} as year_share,
    {r6("exp(-0.5 * (least(abs(hour - 20), 24 - abs(hour - 20)) / 2) ** 2)")} as evening from h"""
ORACLE["eval_crop"] = f"""with {EV}, b as (select series_id, count(*) as n, coalesce(min(case when label = 1 then row_idx end), 0) as first from ev group by 1),
s as (select series_id, case when n <= 30 or first < 0.8 * 30 then 0 else least(first - 15, n - 30) end as st from b)
select e.series_id, row_idx, label from ev e join s on s.series_id = e.series_id where row_idx >= st and row_idx < st + 30"""
_Q = "greatest(1e-7, least(1 - 1e-7, score))"
ORACLE["losses"] = f"""with {SCORES} select series_id, {r6(f"avg({_LOSS})")} as bce,
{r6(f"avg(case when label = 1 then -0.25 * (1 - {_Q}) ** 2 * ln({_Q}) else -0.75 * {_Q} ** 2 * ln(1 - {_Q}) end)")} as focal from sc where label >= 0 group by 1"""
ORACLE["event_bins"] = f"""with {EV}, b as (select floor(t / 3600) * 3600 as bin, count(*) as total, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'view') as views, max(case when value > 400 then 1 else 0 end) as alert from ev group by 1),
g as (select cast(unnest(generate_series(cast(min(bin) as bigint), cast(max(bin) as bigint), 3600)) as double) as bin from b)
select g.bin, coalesce(total, 0) as total, coalesce(errors, 0) as errors, coalesce(views, 0) as views, coalesce(alert, 0) as alert from g left join b on b.bin = g.bin"""
ORACLE["source_quality"] = f"""with {EV}, g as (select event_type, t - lag(t) over (partition by event_type order by t, event_id) as gap from ev),
s as (select event_type, avg(gap) as mean_gap, stddev_pop(gap) / avg(gap) as gap_variation from g group by 1),
h as (select event_type, floor(t / 3600) * 3600 as bin, count(*) as n from ev group by 1, 2),
f as (select event_type, cast(unnest(generate_series(cast(min(bin) as bigint), cast(max(bin) as bigint), 3600)) as double) as bin from h group by 1),
j as (select f.event_type, f.bin, coalesce(n, 0) as n from f left join h on h.event_type = f.event_type and h.bin = f.bin),
l as (select event_type, n, lag(n) over (partition by event_type order by bin) as before from j), a as (select event_type, corr(n, before) as volume_autocorrelation from l group by 1),
d as (select event_type, floor((t - floor(t / 86400) * 86400) / 3600) as h, count(*) as n from ev group by 1, 2), p as (select event_type, max(n) / avg(n) as peak_hour from d group by 1)
select s.event_type, {r6("mean_gap")} as mean_gap, {r6("gap_variation")} as gap_variation, {r6("volume_autocorrelation")} as volume_autocorrelation, {r6("peak_hour")} as peak_hour
from s join a on a.event_type = s.event_type join p on p.event_type = s.event_type"""
ORACLE["corr_graph_reach"] = f"""with recursive {HOURS}, p as (select a.channel, b.channel as partner, corr(a.n, b.n) as r from hours a join hours b on a.bin = b.bin and a.channel <> b.channel group by 1, 2),
k as (select *, row_number() over (partition by channel order by round(abs(r), 9) desc, partner) as k from p), e as (select channel, partner from k where k = 1),
reach as (select channel as a, partner as b from e union select r.a, e.partner from reach r join e on e.channel = r.b) select a, b from reach"""
ORACLE["detect_rows"] = f"""with {EV}, {scaled("ev", "series_id")}, q as (select series_id, least(1, greatest(0, 1 - exp(-greatest(abs(z) - 3, 0)))) as p from z)
select series_id, count(*) as n, cast(count(*) filter (p > 0.3) as bigint) as n_anomalies, {r6("max(p)")} as top from q group by 1"""
ORACLE["detect_calibrated"] = f"""with {EV}, {scaled("ev", "series_id")}, q as (select series_id, least(1 - 1e-7, greatest(1e-7, 1 - exp(-greatest(abs(z) - 3, 0)))) as p from z),
s as (select series_id, 1 / (1 + exp(-(ln(p / (1 - p)) / 1.5 + 0.2))) as s from q)
select series_id, cast(count(*) filter (s > 0.65) as bigint) as n_low, cast(count(*) filter (s > 0.18) as bigint) as n_high from s group by 1"""
ORACLE["first_positive_rows"] = f"""with {EV}, p as (select *, row_number() over (partition by series_id, label = 1 order by row_idx) as k from ev)
select series_id, row_idx, case when label = 1 and (series_id % 5 = 0 or k > 3) then -1 else label end as label from p"""
ORACLE["first_rows_of_runs"] = f"""with {EV}, {RUNS.format(src="ev", label=1)}
select e.series_id, e.row_idx, case when e.row_idx - r.start >= 2 then -1 else e.label end as label from ev e left join runs r on r.series_id = e.series_id and e.row_idx >= r.start and e.row_idx < r.stop"""
ORACLE["status_log_labels"] = f"""with {EV}, last as (select series_id, max(t) + 600 as last from ev group by 1),
lg as (select e.series_id, t as a, coalesce(case when event_id % 100 = 0 then t + 90000 end, last) as b, case event_type when 'error' then 2 when 'view' then 1 end as hit from ev e join last l on l.series_id = e.series_id where event_id % 50 = 0),
n as (select *, lead(t) over (partition by series_id order by t) as nxt from ev)
select series_id, row_idx, coalesce((select case max(hit) when 2 then 1 when 1 then -1 end from lg where lg.series_id = n.series_id and (t between a and b or (t <= a and (nxt is null or nxt > a)))), 0) as label from n"""
ORACLE["train_part_unknown"] = f"with {EV} select series_id, row_idx, case when row_idx < floor(count(*) over (partition by series_id) * 0.7) then -1 else label end as label from ev"
ORACLE["outer_align"] = f"""with {HOURS}, a as (select bin, value from hours where channel = 1 and cast(bin as bigint) % 7200 = 0), b as (select bin, value from hours where channel = 3 and cast(bin as bigint) % 10800 = 0)
select coalesce(a.bin, b.bin) as bin, {r6("a.value")} as error, {r6("b.value")} as signup from a full join b on a.bin = b.bin"""
ORACLE["positional_join"] = f"""with {EV}, {DAYS}, m as (select row_idx, max(label) as label from ev group by 1)
select series_id, d.row_idx, coalesce(m.label, -1) as label from days d left join m on m.row_idx = d.row_idx"""
ORACLE["smallest_of_group"] = """with p as (select ['solar_power', 'taxi_', 'era5_1999', 'x solar_power', 'm4_'][p_partkey % 5 + 1] || ' ' || p_brand as subset, p_name as file, p_partkey as size from part where p_partkey % 5 <> 2),
k as (select *, row_number() over (partition by subset order by size, file) as k from p)
select subset, file, case when subset like 'taxi%' then 'transport' when subset like 'solar%' then 'energy' when subset like 'm4%' then 'mixed_business' else 'unknown' end as sector from k where k = 1"""
ORACLE["role_counts"] = f"select role, count(*) as n, min(series_id) as first from ({ORACLE['role_assignment']}) group by 1"
ORACLE["per_source_subset"] = """with s as (select distinct user_id as series_id, user_id % 11 as source from events), k as (select *, row_number() over (partition by source order by series_id) as place from s)
select * from k where place <= 3"""
_WINDOWS = """win as (select series_id, cast(floor(row_idx / {n}) as bigint) as "window", row_idx, label, 0 as channel, value from ev
union all select series_id, cast(floor(row_idx / {n}) as bigint), row_idx, label, 1, case when event_id % 3 = 0 then value end from ev union all select series_id, cast(floor(row_idx / {n}) as bigint), row_idx, label, 2, 5.0 from ev)"""
ORACLE["usable_window_channels"] = f"""with {EV}, {_WINDOWS.format(n=6)}
select series_id, "window", channel, count(*) as n, count(value) as n_values from win group by 1, 2, 3 having count(distinct value) > 1"""
ORACLE["dense_window_reject"] = f"""with {EV}, {_WINDOWS.format(n=3)}, r as (select series_id, "window", row_idx, bool_or(label = 1) as hit from win group by 1, 2, 3)
select series_id, "window", count(*) as n_rows from r group by 1, 2 having count(*) filter (hit) <= 0.6 * count(*) or series_id % 3 = 0"""
ORACLE["learned_sources"] = """with p as (select p_partkey, ['hai', 'cats', 'ucr', 'lead', 'w3', 'esa'][p_partkey % 6 + 1] as source,
    ['hai-20.07/test', 'hai-22.04/test', 'x/train', 'train/x', 'ECG1', 'hai-21.03/train', null][p_partkey % 7 + 1] as path from part)
select p_partkey, coalesce(case source when 'hai' then contains(path, '/test') and (contains(path, 'hai-20.07') or contains(path, 'hai-21.03'))
    when 'cats' then ends_with(path, '/train') when 'esa' then ends_with(path, '/train') when 'lead' then true else false end, false) as learned,
    case when source = 'ucr' and contains(path, 'ECG') then 'ucr_physiology' else source end as source from p"""
ORACLE["aggregation_choice"] = f"""with {_P}, s as (select row_idx, 'max' as way, {r6("most")} as score from l union all select row_idx, 'topk3', {r6("list_sum(top) / len(top)")} from l
    union all select row_idx, 'noisy_or3', {r6("1 - (1 - least(top[1], 1 - 1e-6)) * (1 - least(top[2], 1 - 1e-6)) * (1 - least(top[3], 1 - 1e-6))")} from l),
sc as (select way, row_idx % 12 as series_id, row_idx % 7 = 0 as hit, score from s),
one as (select way, series_id, score, count(*) filter (hit) as pos, count(*) filter (not hit) as neg from sc group by 1, 2, 3),
c as (select *, sum(pos) over d as tp, sum(neg) over d as fp, sum(pos) over e as p, sum(neg) over e as n from one
    window d as (partition by way, series_id order by score desc rows between unbounded preceding and current row), e as (partition by way, series_id)),
m as (select way, series_id % 4 as source, series_id, (sum(pos / p * tp / (tp + fp)) + sum(pos * (n - fp + neg / 2) / (p * n))) / 2 as s from c where p > 0 and n > 0 group by 1, 2, 3),
g as (select way, source, avg(s) as s from m group by 1, 2), t as (select way, avg(s) filter (source < 2) as u, avg(s) filter (source >= 2) as k from g group by 1),
x as (select *, coalesce(0.7 * u + 0.3 * k, u, k) as score from t),
b as (select case when max(score) <= max(score) filter (way = 'max') + 0.01 then 'max' else arg_max(way, score) end as way from x)
select way, {r6("u")} as unseen_score, {r6("k")} as seen_score, {r6("score")} as score, way = (select way from b) as chosen from x"""
ORACLE["benchmark_table"] = f"""with {RANKED}, {_vus((0, 16, 64, 256))},
b as (select series_id, avg(label) as anomaly_share, avg((score - label) ** 2) as brier, avg({_LOSS}) as nll from sc where label >= 0 group by 1),
j as (select b.*, b.series_id % 9 as source, average_precision, roc_auc, best_f1, vus_pr from b left join ranked r on r.series_id = b.series_id left join vus v on v.series_id = b.series_id),
t as (select source, count(*) as n_series, {", ".join(f"avg({c}) as {c}" for c in ("anomaly_share", "average_precision", "vus_pr", "roc_auc", "best_f1", "brier", "nll"))} from j group by 1)
select source, n_series, {", ".join(f"{r6(c)} as {c}" for c in ("anomaly_share", "average_precision", "vus_pr", "roc_auc", "best_f1", "brier", "nll"))},
    {r6("(anomaly_share + 0.5) / 2")} as chance, {r6("case when source > 1 then vus_pr - average_precision end")} as gain from t"""
ORACLE["false_alarm_channels"] = f"""with {EMB}, {scaled("emb", "series_id, channel")}, f as (
    select series_id, channel, avg(case when round(1 - exp(-abs(z)), 9) > 0.7 then 1.0 else 0.0 end) as rate from z where row_idx % 7 <> 0 and row_idx % 5 <> 0 group by 1, 2),
k as (select *, row_number() over (partition by series_id order by rate desc, channel) as place from f) select series_id, channel, {r6("rate")} as rate, place from k where place <= 5"""
ORACLE["inject_template"] = f"""with {EV}, {scaled("ev", "series_id")}, tb as (select place, z, lead(z) over (order by place) as nz from ({ORACLE["template_bank"]}) where series_id = 'A' and start = 60 and channel = 0 and place >= 0),
sz as (select max(place) + 1 as m from tb), s as (select series_id, max(row_idx) + 1 as n, 5 + series_id % 3 as b, case when series_id % 2 = 0 then 0.25 else 0.5 end as f from ev group by 1),
pl as (select series_id, b, round(m * f) as nn, round(12 * f) as ne, m from s, sz where b + round(m * f) < n),
j as (select e.*, p.b, ne, case when row_idx >= p.b and row_idx < p.b + nn then cast(row_idx - p.b as double) * (m - 1) / (nn - 1) end as x from z e left join pl p on p.series_id = e.series_id),
k as (select j.*, value + (tb.z + (x - place) * (coalesce(nz, tb.z) - tb.z)) * scale * 1.5 as new, tb.z is not null and row_idx < b + ne as hit from j left join tb on tb.place = floor(x)),
u as (select series_id, coalesce(avg(abs(new - value) / scale) filter (hit) >= 0.3, false) and not coalesce(bool_or(label = 1) filter (hit), false) as used from k group by 1)
select k.series_id, row_idx, {r6("case when used then coalesce(new, value) else value end")} as value, case when used and hit then 1 else label end as label, case when used and hit then -1 else 0 end as type
from k join u on u.series_id = k.series_id"""
ORACLE["weighted_series_pick"] = f"""with c as (select c_custkey as series_id, c_mktsegment as sector, cast(c_acctbal as double) as size from customer where c_acctbal > 0),
k as (select *, row_number() over (partition by sector order by -ln((series_id * 7919 % 1009 + 1) / 1009) / sqrt(size), series_id) as k from c) select series_id, sector, {r6("size")} as size from k where k <= 3"""
ORACLE["random_drop"] = f"""with {EV}, f as (select * from ev where (event_id * 31 + series_id) % 97 / 97 < 2 / 3), s as (select *, t - lag(t) over (partition by series_id order by row_idx) as step from f)
select series_id, row_idx, label, {r6("coalesce(ln(1 + step / greatest(median(step) over (partition by series_id), 1e-12)), 0)")} as delta_t from s"""
ONE = """one as (select row_number() over (order by ts, event_id) - 1 as row_idx, epoch_us(ts) / 1e6 as t, value as full_value, case when event_id % 17 = 0 then null else value end as value,
    case event_type when 'error' then 1 when 'signup' then -1 else 0 end as label from events),
filled as (select *, last_value(value ignore nulls) over (order by row_idx rows between unbounded preceding and current row) as ff from one)"""
ORACLE["one_series_scans"] = f"""with {ONE}, r as (select row_idx, min(row_idx) over (partition by g) as run_start from (select row_idx, row_idx - row_number() over (order by row_idx) as g from one where label = 1))
select f.row_idx, {r6("ff")} as filled, {r6("ff - lag(ff) over w")} as diff, {r6("t - lag(t) over w")} as step, run_start, cast(count(*) filter (label = 1) over w as bigint) as anomalies,
    {r6("exp(sum(ln(1 + value * 1e-6)) over w)")} as growth, {r6("max(value) over w")} as highest, {r6("min(value) over w")} as lowest
from filled f left join r on r.row_idx = f.row_idx window w as (order by f.row_idx)"""
ORACLE["one_series_repairs"] = f"""with {ONE}, g as (select *, case when label = 1 then row_idx - row_number() over (partition by label order by row_idx) end as run from one),
cut as (select row_idx, case when label = 1 and row_number() over (partition by run order by row_idx) > 2 and run is not null then -1 else label end as label from g),
fixed as (select row_idx, case when label = 1 and sum(case when label = 0 then 1 else 0 end) over (order by row_idx) < least(200, floor(count(*) over () / 10)) then -1 else label end as label from cut),
v as (select 0 as series_id, row_idx, coalesce(ff, (select median(ff) from filled), 0) as value from filled), {scaled("v", "series_id")}
select z.row_idx, label, {r6("z")} as z from z join fixed on fixed.row_idx = z.row_idx"""
ORACLE["channel_quantiles"] = f"""with c as (select unnest(['price', 'quantity', 'balance']) as channel,
    unnest([cast(l_extendedprice as double), cast(l_quantity as double), cast((l_extendedprice - 30000) * (1 - l_discount) as double)]) as value from lineitem)
select channel, {r6("quantile_cont(value, 0.1)")} as low, {r6("quantile_cont(value, 0.5)")} as middle, {r6("quantile_cont(value, 0.9)")} as high, {r6("min(value)")} as least, {r6("max(value)")} as most from c group by 1"""
ORACLE["result_frame"] = f"""with {EV}, {scaled("ev", "series_id")}, q as (select *, least(1, greatest(0, 1 - exp(-greatest(abs(z) - 3, 0)))) as p from z)
select series_id, row_idx, {r6("t")} as timestamp, {r6("value")} as ch_0, {r6("p")} as score, cast(p > 0.3 as int) as anomaly from q"""
ORACLE["window_scores"] = f"""with {DAYS}, n as (select series_id, count(*) as total from days group by 1),
st as (select series_id, total, unnest(case when total <= 512 then [0] else range(0, total - 511, 256) end) as start from n union select series_id, total, total - 512 from n where total > 512 and (total - 512) % 256 <> 0),
w as (select d.*, start, row_idx - start as place, least(512, total) as len from days d join st on st.series_id = d.series_id and row_idx >= start and row_idx < start + 512), {scaled("w", "series_id, start")},
p as (select *, least(1, greatest(0, 1 - exp(-greatest(abs(z) - 3, 0)))) as p, (1 - abs(2 * place / (len - 1) - 1)) * 0.9 + 0.1 as weight from z)
select series_id, row_idx, 0 as channel, {r6("sum(p * weight) / sum(weight)")} as p from p group by series_id, row_idx"""


def blocks(factor: int, src: str = "days") -> str:
    """Means of whole blocks of rows of ``src``, in a CTE."""
    return f"""b{factor}_{src} as (select series_id, row_idx // {factor} as block, avg(value) as value from (select *, count(*) over (partition by series_id) // {factor} * {factor} as whole from {src})
    where row_idx < whole group by 1, 2)"""


def probability(z: str, name: str) -> str:
    return f"{name} as (select *, least(1, greatest(0, 1 - exp(-greatest(abs(z) - 3, 0)))) as p from {z})"


ORACLE["multi_scale_scores"] = f"""with {DAYS}, {scaled("days", "series_id")}, {probability("z", "p1")},
{blocks(4)}, {scaled("b4_days", "series_id", "z4")}, {probability("z4", "p4")}, {blocks(16)}, {scaled("b16_days", "series_id", "z16")}, {probability("z16", "p16")},
n as (select series_id, count(*) as total from days group by 1)
select a.series_id, row_idx, 0 as channel, {r6("case when total > 1000 then ((a.p + b.p) / 2 + c.p) / 2 else a.p end")} as p from p1 a join n on n.series_id = a.series_id
left join p4 b on b.series_id = a.series_id and b.block = least(row_idx // 4, total // 4 - 1) left join p16 c on c.series_id = a.series_id and c.block = least(row_idx // 16, total // 16 - 1)"""
_AGAINST = """{name} as (select a.series_id, {at}, least(1, greatest(0, 1 - exp(-greatest(abs(greatest(-50, least(50, (a.value - centre) / case when mad > 1e-8 then mad when sd > 1e-8 then sd else 1 end))) - 3, 0)))) as p
    from {src} a join {ref}_m r on r.series_id = a.series_id)"""
ORACLE["scales_with_reference"] = f"""with {DAYS}, early as (select * from days where row_idx < 200), {scaled("early", "series_id", "r1")}, {blocks(4, "early")}, {scaled("b4_early", "series_id", "r4")}, {blocks(4)},
{_AGAINST.format(name="p1", at="row_idx", src="days", ref="r1")}, {_AGAINST.format(name="p4", at="block", src="b4_days", ref="r4")}, n as (select series_id, count(*) as total from days group by 1)
select a.series_id, row_idx, 0 as channel, {r6("case when total > 1000 then (a.p + b.p) / 2 else a.p end")} as p
from p1 a join n on n.series_id = a.series_id left join p4 b on b.series_id = a.series_id and b.block = least(row_idx // 4, total // 4 - 1)"""
ORACLE["interval_cell_labels"] = f"""with {HOURS}, h as (select bin as timestamp, max(case when n % 7 = 0 then 1 else 0 end) as marked from hours group by 1),
s as (select epoch_us(ts) / 1e6 as a, epoch_us(ts) / 1e6 + 600 * (event_id % 11) as b, unnest([1, user_id % 5, event_id % 5]) as channel from events where event_type = 'error'),
c as (select timestamp, marked, unnest(range(5)) as channel from h), hit as (select distinct timestamp, channel from h join s on timestamp between a and b)
select c.timestamp, c.channel, case when c.timestamp in (select timestamp from hit) then cast(hit.channel is not null as int) else marked end as label
from c left join hit on hit.timestamp = c.timestamp and hit.channel = c.channel"""
ORACLE["buyer_reach"] = """with recursive o as (select o_custkey as a, max(o_orderkey) as k from orders group by 1), e as (select a, a + 1 + k % 3 as b from o where a % 10 < 8),
reach as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b) select a, count(*) as reached, max(b) as furthest from reach group by 1"""
ORACLE["channel_correlations"] = f"""with {EMB} select a.series_id, a.channel, b.channel as partner, {r6("corr(a.value, b.value)")} as r, count(*) as n
from emb a join emb b on a.series_id = b.series_id and a.row_idx = b.row_idx and a.channel < b.channel group by 1, 2, 3"""
ORACLE["training_draws"] = """with c as (select o_custkey as series_id, count(*) * 30 as n_rows from orders group by 1),
k as (select series_id, c_mktsegment as sector, n_rows, 1 + series_id % 9 as nc, case when series_id % 3 = 0 then 'row' else 'cell' end as level, floor(sqrt(n_rows)) as w from c join customer on c_custkey = series_id),
l as (select *, sum(w) over (partition by sector order by series_id) as upto, sum(w) over (partition by sector) as whole, dense_rank() over (order by sector) - 1 as g from k),
i as (select o_orderkey as item, (o_orderkey * 7919 + 104729) % 10007 / 10007 as ug, (o_orderkey * 7919 + 2 * 104729) % 10007 / 10007 as ur, (o_orderkey * 7919 + 3 * 104729) % 10007 / 10007 as uf,
    (o_orderkey * 7919 + 4 * 104729) % 10007 / 10007 as ul, (o_orderkey * 7919 + 5 * 104729) % 10007 / 10007 as uw, (o_orderkey * 7919 + 6 * 104729) % 10007 / 10007 as us,
    (o_orderkey * 7919 + 7 * 104729) % 10007 / 10007 as uc from orders),
d as (select * from i join l on g = floor(ug * (select count(distinct sector) from l)) and ur >= (upto - w) / whole and ur < upto / whole),
f as (select *, [1, 1, 1, 2, 3, 4, 7, 8, 12][cast(floor(uf * 9) as int) + 1] as f0 from d),
h as (select *, case when n_rows // f0 < 40 then 1 else f0 end as factor from f),
n as (select *, n_rows // factor as steps, least(case when uw < 0.5 then 200 else 20 + floor(ul * 181) end, n_rows // factor) as length from h)
select item, sector, series_id, factor, cast(length as bigint) as length, cast(floor(us * (steps - length + 1)) as bigint) as start,
    case when level = 'row' then nc else least(nc, greatest(1, cast(round_even(exp(uc * ln(nc)), 0) as int))) end as channels from n"""
ORACLE["batches_by_size"] = """with i as (select l_orderkey as item, cast(sum(l_quantity) as bigint) as n_rows, count(*) as n_channels from lineitem group by 1),
k as (select *, length(bin(n_rows)) as b, length(bin(n_channels)) as d from i),
c as (select *, (b * 8 + cast(floor(n_rows * 4 / pow(2.0, b - 1)) as int)) || '/' || (d * 8 + cast(floor(n_channels * 4 / pow(2.0, d - 1)) as int)) as bucket from k)
select item, n_rows, n_channels, bucket, cast(floor((row_number() over (partition by bucket order by n_rows * n_channels, item) - 1)
    / greatest(1, floor(20000 / (max(n_rows) over (partition by bucket) * max(n_channels) over (partition by bucket))))) as bigint) as batch from c"""
_VARIANTS = {
    "subtle": (2, "value + 1.8 * scale"), "noisy": (3, "held + 0.02 * scale * noise"), "stuck": (3, "extreme + 0.03 * scale * noise"), "linear": (4, "value + 4 * scale * ramp"),
    "worn": (4, "value + 2 * scale * ramp * ramp + 1.6 * scale * ramp * noise"), "ramped": (5, "value + 2 * scale * (0.2 + 0.8 * ramp) * noise"), "collapse": (5, "earlier + (value - middle) * 0.07"),
}
_PARTS = " union all ".join(f"select '{v}' as variant, {i} as id, series_id, row_idx, value, scale, hit, case when hit then {new} else value end as new from m" for v, (i, new) in _VARIANTS.items())
ORACLE["inject_variants"] = f"""with {DAYS}, {scaled("days", "series_id")}, k as (select series_id, max(value) filter (row_idx = 100) as held, quantile_cont(value, 0.95) as extreme,
    median(value) filter (row_idx >= 100 and row_idx < 140) as middle, median(value) filter (row_idx >= 60 and row_idx < 100) as earlier from days group by 1),
m as (select z.series_id, row_idx, value, scale, held, extreme, middle, earlier, row_idx >= 100 and row_idx < 140 as hit, (row_idx - 100) / 39 as ramp, 2 * sin(row_idx * 12.9898) as noise from z join k on k.series_id = z.series_id),
n as ({_PARTS}), e as (select variant, series_id, coalesce(avg(case when hit then abs(new - value) / scale end) >= 0.3, false) as ok from n group by 1, 2)
select n.variant, n.series_id, row_idx, {r6("case when hit and ok then new else value end")} as value, case when hit and ok then 1 else 0 end as label, case when hit and ok then id else 0 end as type
from n join e on e.variant = n.variant and e.series_id = n.series_id"""
_WIDE = """wide as (select series_id, row_idx, unnest([0, 1]) as channel, unnest([case when row_idx % 90 >= 60 and row_idx % 90 < 72 then value * 3 else cast(value as double) end, value + row_idx % 5]) as value from days)"""
ORACLE["inject_inverted"] = f"""with {DAYS}, {_WIDE}, {scaled("wide", "series_id, channel")},
r as (select a.series_id, corr(a.value, b.value) as r from wide a join wide b on a.series_id = b.series_id and a.row_idx = b.row_idx and a.channel = 0 and b.channel = 1 group by 1),
k as (select series_id, channel, median(value) as middle from wide where row_idx >= 100 and row_idx < 140 group by 1, 2),
m as (select a.series_id, a.row_idx, a.channel, a.value, a.scale, a.row_idx >= 100 and a.row_idx < 140 as hit, case when abs(r) >= 0.5 then k.middle - (b.value - l.middle) * a.scale / b.scale else a.value end as new
    from z a join z b on b.series_id = a.series_id and b.row_idx = a.row_idx and b.channel = 1 - a.channel join r on r.series_id = a.series_id
    join k on k.series_id = a.series_id and k.channel = a.channel join k l on l.series_id = a.series_id and l.channel = b.channel),
e as (select series_id, channel, coalesce(avg(case when hit then abs(new - value) / scale end) >= 0.3, false) as ok from m group by 1, 2)
select m.series_id, row_idx, m.channel, {r6("case when hit and ok then new else value end")} as value, case when hit and ok then 1 else 0 end as label, case when hit and ok then 7 else 0 end as type
from m join e on e.series_id = m.series_id and e.channel = m.channel"""
ORACLE["cell_context_fix"] = f"""with {EV}, c as (select series_id, row_idx, unnest([0, 1]) as channel, unnest([label, case when event_id % 3 = 0 then label else 0 end]) as label from ev),
rl as (select series_id, row_idx, case when max(case when label = 1 then 1 else 0 end) = 1 then 1 when min(case when label = 0 then 1 else 0 end) = 1 then 0 else -1 end as label from c group by 1, 2),
g as (select *, row_idx - row_number() over (partition by series_id, label order by row_idx) as run from rl),
cut as (select series_id, row_idx, case when label = 1 and row_number() over (partition by series_id, label, run order by row_idx) > 2 then -1 else label end as label from g),
fixed as (select series_id, row_idx, case when label = 1 and sum(case when label = 0 then 1 else 0 end) over (partition by series_id order by row_idx) < least(6, floor(count(*) over (partition by series_id) / 10)) then -1 else label end as label from cut)
select c.series_id, c.row_idx, channel, case when f.label = -1 and c.label = 1 then -1 else c.label end as label from c join fixed f on f.series_id = c.series_id and f.row_idx = c.row_idx"""
ORACLE["parsed_times"] = f"""with {EV} select event_id, {r6("case when series_id % 2 = 0 then round(t * 1000) / 1000 else floor(t) end")} as timestamp from ev"""
ORACLE["real_event_table"] = f"""with {_STATS} select case series_id when 'A' then 'lead' else 'kelmarsh' end as source, count(*) as events, {r6("median(duration)")} as duration, {r6("median(amplitude)")} as amplitude, {r6("median(onset)")} as onset,
{r6("median(affected_share)")} as affected_share, {r6("avg(coalesce(variance_ratio < 0.5, false)::int)")} as calms, {r6("avg(persists::int)")} as persists from stats where series_id in ('A', 'R') group by 1"""

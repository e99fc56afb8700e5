"""The registered queries of the timeline operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scalars as sc
from spanloom.operators import aggs, events, folds, intervals, joins, scoring, sequences
from spanloom.plans import fusion
from spanloom.sources import documents, views
from spanloom.staging import staged

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Common table expressions of the views, for the SQL side.
REGIONS = """regions as (select user_id as v, event_id as ord, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6::double / 600.0::double as "start",
 (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6::double / 600.0::double + value * 0.5::double as "end",
 case event_type when 'click' then 'black' when 'view' then 'white' when 'purchase' then 'bars' when 'signup' then 'snow' when 'error' then 'silence' else 'freeze' end as kind from events)"""
TURNS = """t0 as (select conv_id as v, turn as ord, role as speaker, text, length(text) * 1000000 // 15 as dur, (length(text) % 5) * 750000 as pause from conversations),
t1 as (select *, coalesce(sum(dur + pause) over (partition by v order by ord rows between unbounded preceding and 1 preceding), 0) as since from t0),
turns as (select v, ord, speaker, since::double / 1e6::double as "start", (since + dur)::double / 1e6::double as "end", text from t1)"""
SAMPLES = """samples as (select user_id as v, event_id as ord, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6::double / 600.0::double as t, event_type as label from events)"""


def islands_sql(source: str, gap: float, name: str, extra: str = "") -> str:
    """CTEs that merge the intervals of ``source`` into ``name``."""
    return f"""{name}_a as (select *, max("end") over (partition by v order by "start", ord rows between unbounded preceding and 1 preceding) as reach from {source}),
{name}_b as (select *, sum(case when reach is null or "start" - reach > {gap} then 1 else 0 end) over (partition by v order by "start", ord rows unbounded preceding) as island from {name}_a),
{name} as (select v, island, min("start") as "start", max("end") as "end", count(*) as n{extra} from {name}_b group by v, island)"""


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _durations(s, d):
    return views.regions(s, d, dealt=False).groupBy("v").agg(F.max("end").alias("duration"))


def _speech(s, d):
    return intervals.merge_intervals(views.regions(s, d).filter("kind = 'silence'"), 5.0)


@query(f'with {REGIONS}, {islands_sql("regions", 2.0, "m")} select v, "start", "end", n from m')
def merge_intervals(s, d):
    return intervals.merge_intervals(views.regions(s, d), 2.0)


@query(f'with {REGIONS}, {islands_sql("regions", 2.0, "m")} select v, "start", "end", n from m')
def merge_intervals_bucketed(s, d):
    return intervals.merge_salted(views.regions(s, d, dealt=False), 2.0, 600.0).select("v", "start", "end", "n")


@query(f"""with {REGIONS}, {islands_sql("regions", 2.0, "m")} select v, count(*) as n_spans, sum(round(("end" - "start") * 1e6::double)::bigint)::double / 1e6::double as covered_s from m group by v""")
def covered_seconds(s, d):
    return intervals.covered_seconds(intervals.merge_intervals(views.regions(s, d), 2.0))


@query(f"""with {REGIONS}, {islands_sql("regions", 2.0, "m")}, dur as (select v, max("end") + 10 as duration from regions group by v),
g as (select v, coalesce(lag("end") over (partition by v order by "start"), 0.0::double) as a, "start" as b from m union all
 select dur.v, max(m."end") as a, any_value(duration) as b from dur join m using (v) group by dur.v)
select v, a as "start", b as "end" from g where b > a + 0.1::double""")
def complement_spans(s, d):
    dur = views.regions(s, d, dealt=False).groupBy("v").agg((F.max("end") + 10).alias("duration"))
    return intervals.complement(intervals.merge_intervals(views.regions(s, d), 2.0), dur)


@query(f"""with {REGIONS}, c as (select v, ord, kind, greatest("start", 100.0::double) as "start", least("end", 400.0::double) as "end" from regions) select * from c where "end" - "start" > 0.05::double""")
def clip_spans(s, d):
    return intervals.clip(views.regions(s, d, dealt=False), F.lit(100.0), F.lit(400.0)).select("v", "ord", "kind", "start", "end")


@query(f"""with {REGIONS}, src as (select * from regions where kind <> 'silence'), holes as (select * from regions where kind = 'silence' and "end" - "start" >= 0.5::double),
{islands_sql("holes", 0.0, "h")},
j as (select s.v, s.ord, s."start" as s0, s."end" as s1, h."start" as hs, h."end" as he from src s left join h on h.v = s.v and h."start" < s."end" and h."end" > s."start"),
p as (select v, ord, greatest(coalesce(lag(he) over (partition by v, ord order by hs), s0), s0) as a, coalesce(hs, s1) as b from j union all
 select v, ord, max(he) as a, any_value(s1) as b from j where hs is not null group by v, ord)
select v, ord, a as "start", b as "end" from p where b - a > 0.05::double""")
def subtract_spans(s, d):
    r = views.regions(s, d)
    return intervals.subtract(r.filter("kind <> 'silence'").select("v", "ord", "start", "end"), r.filter("kind = 'silence'").select("v", "start", "end"))


@query(f"""with {SAMPLES}, p as (select distinct v, t from samples where label <> 'error'),
a as (select *, case when t - lag(t) over (partition by v order by t) <= 40 then 0 else 1 end as n from p), b as (select *, sum(n) over (partition by v order by t rows unbounded preceding) as i from a),
c as (select v, min(t) as "start", max(t) + 20 as "end" from b group by v, i) select * from c where "end" - "start" >= 25""")
def points_to_intervals(s, d):
    return intervals.points_to_intervals(views.samples(s, d).filter("label <> 'error'").select("v", "t"), 20.0, 25.0)


@query(f"""with {REGIONS}, l as (select v, ord, "start" - first_value("start") over (partition by v order by "start", ord) as "start", "end" - first_value("start") over (partition by v order by "start", ord) as "end" from regions where kind in ('black', 'white', 'bars', 'snow')),
a as (select *, coalesce(max("end") over (partition by v order by "start", "end", ord rows between unbounded preceding and 1 preceding), 0) as reach from l),
b as (select *, sum(case when "start" > greatest(2, reach) + 3 or reach >= 180 then 1 else 0 end) over (partition by v order by "start", "end", ord rows unbounded preceding) as broken from a),
e as (select v, max("end") as e from b where broken = 0 group by v), vs as (select distinct v from l)
select vs.v, case when e >= 2 then e else 0 end as leader_end from vs left join e using (v)""")
def head_leader(s, d):
    from pyspark.sql import Window

    r = views.regions(s, d).filter(F.col("kind").isin(*intervals.ANCHORS))
    zero = F.first("start").over(Window.partitionBy("v").orderBy("start", "ord"))
    r = r.withColumn("zero", zero).select("v", "ord", (F.col("start") - F.col("zero")).alias("start"), (F.col("end") - F.col("zero")).alias("end"), "kind")
    return intervals.head_leader_end(r)


def _by_kind(source: str) -> str:
    agg = ", ".join(f"""coalesce(sum(case when kind = '{k}' then "end" - "start" end), 0) as {k}_s, count(*) filter (kind = '{k}') as {k}_n""" for k in ("black", "white", "silence", "bars", "snow"))
    return agg


@query(f"""with {REGIONS}, sil as (select * from regions where kind = 'silence'), {islands_sql("sil", 5.0, "sp")},
{islands_sql("regions", 2.0, "r", ", " + _by_kind("r"))},
q as (select r.*, r."end" - r."start" as dur, exists (select 1 from sp where sp.v = r.v and least(sp."end", r."end") - greatest(sp."start", r."start") >= 2) as spoken from r)
select v, "start", "end", case when dur < (case when bars_n + snow_n > 0 and black_n + white_n = 0 then 1.5 else 3 end) then 'drop' when black_n + white_n + bars_n + snow_n = 0 then 'drop'
 when dur > 30 and (black_s + white_s + bars_s + snow_s) / dur < 0.5 then 'parts' when black_n > 0 and spoken then 'parts' when dur > 60 and silence_s / dur < 0.5 then 'parts' else 'whole' end as decision,
 case when bars_n > 0 then 'bars' when snow_n > 0 then case when snow_s >= black_s then 'snow' else 'black' end when white_n > 0 and black_n = 0 then 'white' else 'black' end as kind from q""")
def dead_span_classes(s, d):
    return intervals.classified_runs(views.regions(s, d), _speech(s, d)).select("v", "start", "end", "decision", "kind")


@query()
def dead_spans_final(s, d):
    return intervals.dead_spans(views.regions(s, d), _durations(s, d), _speech(s, d))


@query()
def full_analysis(s, d):
    return fusion.dead_and_content(views.regions(s, d), _durations(s, d)).withColumns({"dead": F.to_json("dead"), "content": F.to_json("content")})


@query(f"""with {REGIONS}, dur as (select v, max("end") as duration from regions group by v), sl as (select v, sum("end" - "start") as silent from regions where kind = 'silence' group by v),
noisy as (select r.* from regions r join dur using (v) left join sl using (v) where kind <> 'silence' or coalesce(silent, 0) < 0.98 * duration), plain as (select * from noisy where kind <> 'freeze'),
{islands_sql("noisy", 2.0, "bo", ", max(case when kind in ('black', 'white', 'bars', 'snow') then " + '"end" end) as vis')}, {islands_sql("plain", 2.0, "pl", ", min(case when kind in ('black', 'white', 'snow') then " + '"start" end) as vis')},
h as (select v, arg_min(struct_pack(e := "end", vis := vis), island) as h from bo where "start" <= 5 group by v), tl as (select v, arg_max(struct_pack(vis := vis), island) as t from pl join dur using (v) where "end" >= duration - 5 group by v),
c as (select v, duration, coalesce(h.h.e >= duration - 5, false) as whole, coalesce(h.h.vis, 0) as lo, coalesce(tl.t.vis, duration) as hi from dur left join h using (v) left join tl using (v)),
w as (select v, duration, whole, case when whole then 0.0::double else lo end as content_start, case when whole then duration else hi end as content_end from c)
select v, duration, content_start, content_end, case when whole or content_end - content_start <= 0 or (content_end - content_start) / nullif(duration, 0) < 0.5 then 'NEEDS_REVIEW' else 'OK' end as status,
content_end - content_start as kept, coalesce(100 * (content_end - content_start) / nullif(duration, 0), 0) as kept_pct, content_start as head_trim, duration - content_end as tail_trim from w""")
def head_tail_window(s, d):
    return intervals.proposal_columns(intervals.head_tail_window(views.regions(s, d), _durations(s, d), 2.0))


OVERLAP = """j as (select a.v, a.ord, a."start", a."end", b.ord as r_ord, b.kind as r_kind, b."start" as rs, least(a."end", b."end") - greatest(a."start", b."start") as ov
 from regions a join regions b on a.v = b.v and b.kind = 'white' and least(a."end", b."end") - greatest(a."start", b."start") > 0 where a.kind = 'black')"""


@query(f"""with {REGIONS}, {OVERLAP} select v, ord, r_ord, round(ov, 6) as overlap from j""")
def overlap_join(s, d):
    r = views.regions(s, d)
    j = joins.overlap_join(r.filter("kind = 'black'"), joins.right_side(r.filter("kind = 'white'")))
    return j.select("v", "ord", "r_ord", F.round("overlap", 6).alias("overlap"))


@query(f"""with {REGIONS}, {OVERLAP} select v, ord, r_ord, round(ov, 6) as overlap from j""")
def overlap_join_bucketed(s, d):
    r = views.regions(s, d, dealt=False)
    j = joins.overlap_join(r.filter("kind = 'black'"), joins.right_side(r.filter("kind = 'white'")), bucket=120.0)
    return j.select("v", "ord", "r_ord", F.round("overlap", 6).alias("overlap"))


SHOTS = """shots as (select v, row_number() over (partition by v order by ord) as ord, "start", "start" + 20::double as "end" from turns)"""


def _shots(s, d, t=None):
    from pyspark.sql import Window

    t = t if t is not None else views.turns(s, d)
    return t.select("v", F.row_number().over(Window.partitionBy("v").orderBy("ord")).cast("long").alias("ord"), "start", (F.col("start") + 20.0).alias("end"))


@query(f"""with {TURNS}, {SHOTS}, j as (select s.v, s.ord, s."start", s."end", t.speaker, t.text, t.ord as r_ord, t."start" as rs, least(s."end", t."end") - greatest(s."start", t."start") as ov from shots s left join turns t on t.v = s.v and least(s."end", t."end") - greatest(s."start", t."start") > 0)
select v, ord, round(any_value("start"), 2) as "start", round(any_value("end"), 2) as "end", coalesce(least(round((sum(round(ov * 1e6::double)::bigint) / 2e7::double)::decimal(18, 9), 2)::double, 1.0::double), 0) as speech_frac, trim(coalesce(string_agg(text, ' ' order by rs, speaker, text), '')) as text,
coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(list(speaker)), lambda x: struct_pack(a := list_min(list_transform(list_filter(list(struct_pack(o := r_ord, s := speaker)), lambda y: y.s = x), lambda y: y.o)), b := x))), lambda z: z.b), ','), '') as speakers from j group by v, ord""")
def overlap_attach(s, d):
    return joins.attach(_shots(s, d), views.turns(s, d)).withColumn("speakers", F.array_join("speakers", ","))


@query(f"""with {TURNS}, {SHOTS} select s.v, s.ord, trim(coalesce(string_agg(t.text, ' ' order by t.ord), '')) as transcript,
coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(list(t.speaker)), lambda x: struct_pack(a := list_min(list_transform(list_filter(list(struct_pack(o := t.ord, s := t.speaker)), lambda y: y.s = x), lambda y: y.o)), b := x))), lambda z: z.b), ','), '') as speakers from shots s left join turns t on t.v = s.v and least(s."end", t."end") - greatest(s."start", t."start") > 0 group by s.v, s.ord""")
def segment_text(s, d):
    return joins.segment_text(_shots(s, d), views.turns(s, d)).select("v", "ord", "transcript", F.array_join("speakers", ",").alias("speakers"))


@query(f"""with {REGIONS} select a.v, a.ord, a."start", a."end" from regions a where kind = 'black' and exists (select 1 from regions b where b.v = a.v and b.kind = 'silence' and least(a."end", b."end") - greatest(a."start", b."start") >= 2)""")
def speech_veto(s, d):
    r = views.regions(s, d)
    return joins.overlaps_any(r.filter("kind = 'black'"), r.filter("kind = 'silence'")).select("v", "ord", "start", "end")


@query(f"""with {TURNS}, p as (select distinct v, "start" as t from turns),
j as (select p.v, p.t, arg_max(speaker, struct_pack(a := "start", b := ord)) filter ("end" <= p.t + 2) as before, arg_min(speaker, struct_pack(a := "start", b := ord)) filter ("start" >= p.t - 2) as after from p join turns on turns.v = p.v group by p.v, p.t)
select v, t, before, after, coalesce(before <> after, false) as changed from j""")
def speaker_change_asof(s, d):
    t = views.turns(s, d)
    return joins.speaker_change(t.select("v", F.col("start").alias("t")).distinct(), t)


@query(f"""with {TURNS}, p as (select distinct v, round("end" * 0.7::double, 3) as t from turns) select p.v, p.t, arg_min("start", struct_pack(a := abs(p.t - "start"), b := "start")) as near from p join turns on turns.v = p.v group by p.v, p.t""")
def nearest_snap(s, d):
    t = views.turns(s, d)
    return joins.nearest(t.select("v", F.round(F.col("end") * 0.7, 3).alias("t")).distinct(), t.select("v", F.col("start").alias("t")))


@query(f"""with {REGIONS}, {islands_sql("regions", 2.0, "a")}, {islands_sql("regions", 5.0, "b")} select distinct a.v, a."start" as t from a join b on a.v = b.v and abs(a."start" - b."start") <= 2""")
def points_within(s, d):
    r = views.regions(s, d)
    a, b = (intervals.merge_intervals(r, g).select("v", F.col("start").alias("t")) for g in (2.0, 5.0))
    return joins.within(a, b, 2.0)


HOST = """w as (select v, speaker, ord, "start", min("start") over (partition by v) as t0, max("end") over (partition by v) as t1 from turns),
c as (select v, speaker, count(*) as n, count(distinct least(floor(10 * ("start" - t0) / greatest(t1 - t0, 0.01)), 9)) as b, min(ord) as first from w group by v, speaker),
hosts as (select v, arg_min(speaker, struct_pack(a := -(n * b), b := -n, c := first)) as host from c group by v)"""


@query(f"with {TURNS}, {HOST} select v, host from hosts")
def detect_host(s, d):
    return aggs.detect_host(views.turns(s, d))


SPOKEN = """sp as (select s.v, s.ord, t.speaker, sum(round((least(s."end", t."end") - greatest(s."start", t."start")) * 1e6::double)::bigint) as us, min(t.ord) as first from shots s join turns t on t.v = s.v and least(s."end", t."end") - greatest(s."start", t."start") > 0 group by s.v, s.ord, t.speaker)"""


@query(f"""with {TURNS}, {HOST}, {SHOTS}, {SPOKEN}, r as (select v, ord, coalesce(max(case when speaker <> host then us end), 0) as g, coalesce(max(case when speaker = host then us end), 0) as h from sp join hosts using (v) group by v, ord)
select shots.v, shots.ord, case when g >= greatest(6e6, 0.4 * h) then 'guest' else 'host' end as role from shots left join r using (v, ord)""")
def dominant_role(s, d):
    t = views.turns(s, d)
    return aggs.dominant_role(_shots(s, d), t, aggs.detect_host(t))


@query(f"""with {TURNS}, {HOST}, {SHOTS}, {SPOKEN} select shots.v, shots.ord, coalesce(g.guests, '') as guests from shots left join (select v, ord, string_agg(speaker, ',' order by first, speaker) as guests from sp join hosts using (v) where speaker <> host and us >= 1.5e6 group by v, ord) g using (v, ord)""")
def segment_guests(s, d):
    t = views.turns(s, d)
    return aggs.segment_guests(_shots(s, d), t, aggs.detect_host(t)).withColumn("guests", F.array_join("guests", ","))


@query(f"""with {SAMPLES}, c as (select v, label, count(*) as n, min(ord) as first from samples group by v, label), r as (select *, row_number() over (partition by v order by n desc, first) as r from c) select v, string_agg(label, '; ' order by r) as notes from r where r <= 2 group by v""")
def top_notes(s, d):
    return aggs.top_notes(views.samples(s, d))


@query(f"""with {TURNS}, a as (select *, case when lag(speaker) over w = speaker and "start" - lag("end") over w < 3 then 0 else 1 end as n from turns window w as (partition by v order by ord)), b as (select *, sum(n) over (partition by v order by ord rows unbounded preceding) as run from a)
select v, min(ord) as ord, any_value(speaker) as speaker, arg_min("start", ord) as "start", arg_max("end", ord) as "end", string_agg(text, ' ' order by ord) as text from b group by v, run""")
def same_speaker_merge(s, d):
    return sequences.merge_same_speaker(views.turns(s, d))


ATTACHED = """aj as (select s.v, s.ord, s."start", s."end", t.speaker, t.ord as r_ord, least(s."end", t."end") - greatest(s."start", t."start") as ov from shots s left join turns t on t.v = s.v and least(s."end", t."end") - greatest(s."start", t."start") > 0),
af as (select v, ord, round(any_value("start"), 2) as "start", round(any_value("end"), 2) as "end", coalesce(least(round((sum(round(ov * 1e6::double)::bigint) / 2e7::double)::decimal(18, 9), 2)::double, 1.0::double), 0) as frac from aj group by v, ord),
asp as (select v, ord, speaker, min(r_ord) as first from aj where speaker is not null group by v, ord, speaker)"""
PAUSES = """pz as (select v, round((("end" + nx) / 2.0::double)::decimal(18, 6), 2)::double as t from (select *, lead("start") over (partition by v order by "start", ord) as nx from turns) where nx - "end" >= 1.5)"""


@query(f"""with {TURNS}, {HOST}, {SHOTS}, {ATTACHED},
sg as (select v, ord, string_agg(speaker, '|' order by first, speaker) as g from asp join hosts using (v) where speaker <> host group by v, ord),
s1 as (select af.*, case when frac < 0.2 then null when g is not null then 'guest|' || g else 'host' end as sig from af left join sg using (v, ord)),
s2 as (select * exclude (sig), coalesce(last_value(sig ignore nulls) over (partition by v order by ord rows unbounded preceding), first_value(sig ignore nulls) over (partition by v order by ord rows between current row and unbounded following), 'nospeech') as sig from s1),
s3 as (select *, case when lag(sig) over (partition by v order by ord) = sig then 0 else 1 end as n from s2), s4 as (select *, sum(n) over (partition by v order by ord rows unbounded preceding) as run from s3),
who as (select v, run, speaker, min(ord * 1000000 + first) as first from s4 join asp using (v, ord) group by v, run, speaker), said as (select v, run, string_agg(speaker, ',' order by first, speaker) as speakers from who group by v, run),
g as (select v, run, any_value(sig) as sig, arg_min("start", ord) as "start", arg_max("end", ord) as "end" from s4 group by v, run)
select v, (run - 1)::bigint as ord, "start", "end", case when sig like 'guest|%' then 'guest' else sig end as role, coalesce(speakers, '') as speakers from g left join said using (v, run)""")
def speaker_signature(s, d):
    t = views.turns(s, d)
    return sequences.merge_by_speaker(joins.attach(_shots(s, d), t), aggs.detect_host(t)).withColumn("speakers", F.array_join("speakers", ","))


@query(f"""with {TURNS}, n as (select *, lead("start") over (partition by v order by "start", ord) as nx from turns) select v, round((("end" + nx) / 2.0::double)::decimal(18, 6), 2)::double as t from n where nx - "end" >= 1.5""")
def pause_boundaries(s, d):
    return sequences.pause_boundaries(views.turns(s, d))


@query(f"""with {SAMPLES}, a as (select *, case when lag(label) over (partition by v order by ord) = label then 0 else 1 end as n from samples), b as (select *, sum(n) over (partition by v order by ord rows unbounded preceding) as run from a)
select v, ord, t, case when label in ('click', 'view') and count(*) over (partition by v, run) < 2 then 'other' else label end as label from b""")
def confirm_targets(s, d):
    return sequences.confirm_targets(views.samples(s, d), ["click", "view"])


@query(f"""with {SAMPLES}, a as (select *, lag(label) over w as p, lead(label) over w as nx from samples window w as (partition by v order by ord)) select v, ord, t, case when p = nx and p <> label then p else label end as label from a""")
def smooth_labels(s, d):
    return sequences.smooth_labels(views.samples(s, d))


@query(f"""with {SAMPLES}, e as (select v, max(t) + 30 as end_time from samples group by v), a as (select *, lead(t) over w as nx, case when lag(label) over w = label then 0 else 1 end as n from samples window w as (partition by v order by ord)),
b as (select *, sum(n) over (partition by v order by ord rows unbounded preceding) as run from a)
select b.v, (run - 1)::bigint as ord, arg_min(t, ord) as "start", arg_max(coalesce(nx, end_time), ord) as "end", label from b join e using (v) group by b.v, run, label""")
def merge_labels(s, d):
    m = views.samples(s, d)
    return sequences.merge_labels(m, m.groupBy("v").agg((F.max("t") + 30).alias("end_time")))


@query(f"""with {REGIONS}, {islands_sql("regions", 2.0, "m", ", list(distinct kind) as kinds")}, sn as (select v, "start", "end" from regions where kind = 'snow'),
a as (select *, lag("end") over w as pe, lag(kinds) over w as pk, count(*) over (partition by v) as c from m window w as (partition by v order by island)),
b as (select *, case when pe is null or (not list_has_any(kinds, pk) and exists (select 1 from sn where sn.v = a.v and sn."start" <= greatest(pe, a."start") + 2 and sn."end" >= least(pe, a."start") - 2)) then 1 else 0 end as nw from a),
e as (select *, sum(nw) over (partition by v order by island rows unbounded preceding) - 1 as program_index from b), f as (select *, max(program_index) over (partition by v) as last from e)
select v, island::bigint as ord, "start", "end", program_index::bigint as program_index from f where c >= 3 and last > 0""")
def program_groups(s, d):
    r = views.regions(s, d)
    m = intervals.islands(r, 2.0, ["v"]).groupBy("v", F.col("island").alias("ord")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("kind").alias("speakers")).withColumn("caption", F.lit(""))
    return sequences.program_groups(m, r.filter("kind = 'snow'").select("v", "start", "end"))


@query(f"""with {TURNS}, {SHOTS}, {PAUSES}, pts as (select distinct v, "start" as t from turns),
ch as (select p.v, p.t, coalesce(arg_max(speaker, struct_pack(a := "start", b := ord)) filter ("end" <= p.t + 2) <> arg_min(speaker, struct_pack(a := "start", b := ord)) filter ("start" >= p.t - 2), false) as changed from pts p join turns on turns.v = p.v group by p.v, p.t),
gp as (select v, "end" as a, nx as b from (select *, lead("start") over (partition by v order by "start", ord) as nx from turns) where nx - "end" >= 0.8),
c as (select u.v, u.ord, u."start", row_number() over (partition by u.v order by u.ord) as n, exists (select 1 from shots s where s.v = u.v and abs(s."start" - u."start") <= 2) as shot, changed as speaker,
 exists (select 1 from gp where gp.v = u.v and u."start" >= gp.a - 2 and u."start" <= gp.b + 2) as pause, exists (select 1 from pz where pz.v = u.v and abs(pz.t - u."start") <= 2) as lex from turns u join ch on ch.v = u.v and ch.t = u."start"),
k as (select *, case when n = 1 then [] else list_filter([case when shot then 'shot' end, case when speaker then 'speaker' end, case when pause then 'pause' end, case when lex then 'lexical' end, case when lex then 'llm' end], lambda x: x is not null) end as cues from c)
select v, ord, "start", array_to_string(cues, ',') as cues, case when n = 1 or len(cues) >= 3 then 'high' when len(cues) = 2 then 'medium' else 'low' end as confidence from k""")
def boundary_confidence(s, d):
    t = views.turns(s, d)
    seg = t.select("v", "ord", "start")
    pts = sequences.pause_boundaries(t)
    return sequences.boundary_confidence(seg, t, _shots(s, d), pts, pts).withColumn("cues", F.array_join("cues", ","))


@query(f"""with {REGIONS}, sp as (select v, min("start") as "start", max("end") as "end" from regions group by v), w as (select v, "start" + i * 30.0::double as t, "end" from sp, lateral (select unnest(range(0, ceil(("end" - "start") / 30)::bigint)) as i))
select v, t, least(t + 30, "end") as until, round(t + 0.5::double * (least(t + 30, "end") - t), 6) as middle from w""")
def sample_windows(s, d):
    sp = views.regions(s, d, dealt=False).groupBy("v").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return sequences.sample_windows(sp, 30.0, 3).select("v", "t", "until", F.round(F.col("times")[1], 6).alias("middle"))


_STOP = ", ".join("'" + w + "'" for w in sequences.STOP_WORDS.split())
LEXICAL = f"""lw as (select doc_id as v, greatest(n_chars / 15.0::double, 0.01::double) as dur, list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: length(x) > 2 and x not in ({_STOP})) as w from documents where text is not null),
lt as (select v, dur, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from lw), lb as (select v, word, pos, pos // 20 as block, 0.0::double + dur * pos / n as t from lt),
lc as (select v, block, word, count(*) as n from lb group by v, block, word), ls as (select v, max(block) + 1 as blocks from lb group by v having max(block) + 1 >= 12),
lg as (select v, blocks, unnest(range(1, blocks)) as gap from ls),
lx as (select g.v, g.gap, word, sum(case when block < gap then lc.n else 0 end) as a, sum(case when block >= gap then lc.n else 0 end) as b from lg g join lc on lc.v = g.v and lc.block >= g.gap - 6 and lc.block < g.gap + 6 group by g.v, g.gap, word),
lm as (select v, gap, sum(a * b)::double as ab, sum(a * a)::double as aa, sum(b * b)::double as bb from lx group by v, gap),
sim as (select v, gap, coalesce(ab / nullif(sqrt(aa) * sqrt(bb), 0), 0) as sim, t from lm join (select v, block as gap, arg_min(t, pos) as t from lb group by v, block) using (v, gap))"""


@query(f"""with {LEXICAL} select v, gap::integer as gap, round(sim, 6) as sim from sim""")
def lexical_similarity(s, d):
    return sequences.lexical_similarity(views.lexical(s, d)).select("v", "gap", F.round("sim", 6).alias("sim"))


@query(f"""with {LEXICAL}, d1 as (select *, case when lag(sim) over w < sim then 1 when lag(sim) over w is null then 1 else 0 end as nl, case when lead(sim) over w < sim then 1 when lead(sim) over w is null then 1 else 0 end as nr from sim window w as (partition by v order by gap)),
d2 as (select *, sum(nl) over (partition by v order by gap rows unbounded preceding) as l, sum(nr) over (partition by v order by gap rows between current row and unbounded following) as r from d1),
d3 as (select *, first_value(sim) over (partition by v, l order by gap rows unbounded preceding) as lp, last_value(sim) over (partition by v, r order by gap rows between current row and unbounded following) as rp from d2),
d4 as (select *, (lp - sim) + (rp - sim) as depth from d3), d5 as (select *, avg(depth) over (partition by v) as mean, stddev_pop(depth) over (partition by v) as dev, max(depth) over (partition by v order by gap rows between 1 preceding and 1 following) as top from d4)
select v, round(t::decimal(24, 9), 2)::double as t from d5 where depth > mean + 0.3::double * dev and depth = top""")
def lexical_boundaries(s, d):
    return sequences.lexical_boundaries(views.lexical(s, d))


@query()
def coalesce_conversation(s, d):
    t = views.turns(s, d).withColumns({"role": F.when(F.col("speaker") == "user", "guest").otherwise("host"), "guests": F.array("speaker"), "speakers": F.array("speaker"), "label": F.concat(F.lit("l"), (F.length("text") % 3).cast("string")), "name": F.substring("text", 1, 10)})
    return folds.coalesce_conversation(t).withColumn("speakers", F.array_join("speakers", ","))


@query()
def consolidate_segments(s, d):
    m = views.samples(s, d)
    return folds.consolidate_segments(sequences.merge_labels(m, m.groupBy("v").agg((F.max("t") + 30).alias("end_time"))), 0, 20.0)


@query()
def grid_segmentation(s, d):
    m = views.samples(s, d)
    return fusion.grid_segmentation(m, m.groupBy("v").agg((F.max("t") + 30).alias("end_time")), ["click", "view"], 20, 5.0)


@query(f"""with {TURNS}, {SHOTS}, {PAUSES}, seg as (select v, min("start") as "start", max("end") as "end" from turns group by v),
cut as (select seg.v, seg."start", seg."end", pz.t from seg join pz on pz.v = seg.v and pz.t >= seg."start" + 8 and pz.t <= seg."end" - 8),
c as (select distinct v, c from (select cut.v, cut.t, round(coalesce(arg_min(s."start", struct_pack(a := abs(s."start" - cut.t), b := s."start")), cut.t)::decimal(24, 9), 2)::double as c from cut left join shots s on s.v = cut.v and s."start" > cut."start" and s."start" < cut."end" and abs(s."start" - cut.t) <= 3 group by cut.v, cut.t)),
p as (select v, "start" as a, -1 as k from seg union all select v, c, 0 from c), q as (select p.v, p.a, k, coalesce(lead(p.a) over (partition by p.v order by k, p.a), seg."end") as b from p join seg using (v)),
n as (select *, case when row_number() over (partition by v order by k, a) = 1 or b - a >= 8 then 1 else 0 end as nw from q), m as (select *, sum(nw) over (partition by v order by k, a rows unbounded preceding) as piece from n)
select v, (piece - 1)::bigint as ord, arg_min(a, struct_pack(k := k, a := a)) as "start", arg_max(b, struct_pack(k := k, a := a)) as "end" from m group by v, piece""")
def split_on_topics(s, d):
    t = views.turns(s, d)
    seg = t.groupBy("v").agg(F.lit(0).cast("long").alias("ord"), F.min("start").alias("start"), F.max("end").alias("end"))
    return joins.split_on_topics(seg, sequences.pause_boundaries(t), _shots(s, d))


@query()
def fused_timeline(s, d):
    t = staged(views.turns(s, d), "turns")
    dur = t.groupBy("v").agg(F.max("end").alias("duration"))
    dead = sequences.pause_boundaries(t).select("v", (F.col("t") - 0.4).alias("start"), (F.col("t") + 0.4).alias("end"), F.lit("black").alias("kind"))
    return fusion.timeline(fusion.fuse(_shots(s, d, t), t, dead.select("v", "start", "end")), dead, t, dur)


def _pred_gold(s, d):
    r = views.regions(s, d)
    return intervals.merge_intervals(r, 5.0), intervals.merge_intervals(r, 2.0), r.select("v").distinct()


TWO = f'{REGIONS}, {islands_sql("regions", 5.0, "p")}, {islands_sql("regions", 2.0, "g")}'


@query(f"""with {TWO}, s as (select v, sum(round(("end" - "start") * 1e6::double)::bigint) / 1e6::double as p from p group by v), u as (select v, sum(round(("end" - "start") * 1e6::double)::bigint) / 1e6::double as g from g group by v),
o as (select p.v, sum(round((least(p."end", g."end") - greatest(p."start", g."start")) * 1e6::double)::bigint) / 1e6::double as x from p join g on p.v = g.v and least(p."end", g."end") - greatest(p."start", g."start") > 0 group by p.v)
select v, round(x / p, 6) as "precision", round(x / g, 6) as recall, round(2 * (x / p) * (x / g) / (x / p + x / g), 6) as f1, round(x / (p + g - x), 6) as iou from s join u using (v) join o using (v)""")
def dead_metrics(s, d):
    out = scoring.dead_metrics(*(x.withColumn("ord", F.lit(0)) for x in _pred_gold(s, d)[:2]), _pred_gold(s, d)[2])
    return out.select("v", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")))


@query(f"""with {TWO}, pp as (select distinct v, round(unnest([p."start", p."end"]), 2) as t from p), gg as (select distinct v, round(unnest([g."start", g."end"]), 2) as t from g),
a as (select v, count(*) as np, count(*) filter (exists (select 1 from gg where gg.v = pp.v and abs(pp.t - gg.t) <= 2)) as hp from pp group by v), b as (select v, count(*) as ng, count(*) filter (exists (select 1 from pp where gg.v = pp.v and abs(pp.t - gg.t) <= 2)) as hg from gg group by v)
select v, round(hp::double / np, 6) as "precision", round(hg::double / ng, 6) as recall, round(coalesce(2 * (hp::double / np) * (hg::double / ng) / nullif(hp::double / np + hg::double / ng, 0), 0), 6) as f1 from a join b using (v)""")
def boundary_f1(s, d):
    p, g, t = _pred_gold(s, d)
    out = scoring.boundary_metrics(scoring.span_points(p, empty=True), scoring.span_points(g, empty=True), t)
    return out.select("v", *(sc.rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""with {REGIONS}, p as (select v, ord, "start", "end" - 1 as "end", kind as type from regions where ord % 2 = 0), g as (select v, ord, "start", "end", kind as type from regions where ord % 2 = 1),
j as (select g.v, g.ord, g.type, arg_min(p.type, struct_pack(a := -(least(p."end", g."end") - greatest(p."start", g."start")), b := p.ord)) as pt from g join p on p.v = g.v and least(p."end", g."end") - greatest(p."start", g."start") > 0 group by g.v, g.ord, g.type),
a as (select v, count(*) as matched, count(*) filter (type = pt) as agree from j group by v), n as (select v, count(*) as total from g group by v), vs as (select distinct v from regions)
select v, round(case when coalesce(total, 0) = 0 then 0.0 else coalesce(agree::double / nullif(matched, 0), 0) end, 6) as accuracy, coalesce(matched, 0) as matched, coalesce(total, 0) as total from vs left join a using (v) left join n using (v)""")
def type_accuracy(s, d):
    r = views.regions(s, d).withColumnRenamed("kind", "type")
    p = r.filter("ord % 2 = 0").withColumn("end", F.col("end") - 1)
    out = scoring.type_accuracy(p, r.filter("ord % 2 = 1"), r.select("v").distinct())
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query()
def match_greedy(s, d):
    p, g, _ = _pred_gold(s, d)
    return folds.match_greedy(p.select("v", F.col("start").alias("t")), g.select("v", F.col("start").alias("t")))


ERRORS = f"""{TWO}, dur as (select v, max("end") as duration from regions group by v),
nn as (select v, duration, greatest(1, ceil(duration))::bigint as n from dur),
pi as (select distinct p.v, round_even(p."start", 0)::bigint as u, nn.n from p join nn using (v) where p."start" > 1 and p."start" < duration - 1), gi as (select distinct g.v, round_even(g."start", 0)::bigint as u, nn.n from g join nn using (v) where g."start" > 1 and g."start" < duration - 1),
pu as (select v, u from pi where u > 0 and u < n), gu as (select v, u from gi where u > 0 and u < n),
kk as (select nn.v, n, greatest(1, round_even(n::double / (count(gu.u) + 1) / 2, 0))::bigint as k from nn left join gu using (v) group by nn.v, n),
grid as (select v, n, k, unnest(range(0, n)) as u from kk),
lab as (select grid.*, sum(case when gu.u is null then 0 else 1 end) over w as r, sum(case when pu.u is null then 0 else 1 end) over w as h from grid left join gu using (v, u) left join pu using (v, u) window w as (partition by v order by u rows unbounded preceding)),
er as (select a.v, count(*) as c, count(*) filter ((a.r = b.r) <> (a.h = b.h)) as e1, count(*) filter (b.r - a.r <> b.h - a.h) as e2 from lab a join lab b on a.v = b.v and b.u = a.u + a.k group by a.v)"""


@query(f"""with {ERRORS} select v, n, k, round(coalesce(e1::double / c, 0), 6) as pk, round(coalesce(e2::double / c, 0), 6) as windowdiff from kk left join er using (v)""")
def pk_windowdiff(s, d):
    p, g, _ = _pred_gold(s, d)
    out = scoring.segmentation_errors(p.select("v", F.col("start").alias("t")), g.select("v", F.col("start").alias("t")), _durations(s, d))
    return out.select("v", "n", "k", F.round("pk", 6).alias("pk"), F.round("windowdiff", 6).alias("windowdiff"))


@query()
def corpus_rollup(s, d):
    p, g, _ = _pred_gold(s, d)
    a, b = p.select("v", F.col("start").alias("t")), g.select("v", F.col("start").alias("t"))
    return aggs.rollup(folds.match_greedy(a, b).join(scoring.segmentation_errors(a, b, _durations(s, d)), "v"))


@query(f"""with {TWO}, s as (select v, sum(round(("end" - "start") * 1e6::double)::bigint) / 1e6::double as p from p group by v), u as (select v, sum(round(("end" - "start") * 1e6::double)::bigint) / 1e6::double as g from g group by v),
o as (select p.v, sum(round((least(p."end", g."end") - greatest(p."start", g."start")) * 1e6::double)::bigint) / 1e6::double as x from p join g on p.v = g.v and least(p."end", g."end") - greatest(p."start", g."start") > 0 group by p.v),
f as (select v, 2 * (x / p) * (x / g) / (x / p + x / g) as dead_f1 from s join u using (v) join o using (v)),
pp as (select distinct v, round(unnest([p."start", p."end"]), 2) as t from p), gg as (select distinct v, round(unnest([g."start", g."end"]), 2) as t from g),
a as (select v, count(*) filter (exists (select 1 from gg where gg.v = pp.v and abs(pp.t - gg.t) <= 2))::double / count(*) as pr from pp group by v), b as (select v, count(*) filter (exists (select 1 from pp where gg.v = pp.v and abs(pp.t - gg.t) <= 2))::double / count(*) as rc from gg group by v),
tp as (select v, ord, "start", "end" - 1 as "end", kind as type from regions where ord % 2 = 0), tg as (select v, ord, "start", "end", kind as type from regions where ord % 2 = 1),
tj as (select tg.v, tg.ord, tg.type, arg_min(tp.type, struct_pack(a := -(least(tp."end", tg."end") - greatest(tp."start", tg."start")), b := tp.ord)) as pt from tg join tp on tp.v = tg.v and least(tp."end", tg."end") - greatest(tp."start", tg."start") > 0 group by tg.v, tg.ord, tg.type),
ta as (select v, count(*) filter (type = pt)::double / count(*) as acc from tj group by v), tn as (select v, count(*) as total from tg group by v), vs as (select distinct v from regions),
m as (select f.v, dead_f1, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as boundary_f1, case when coalesce(total, 0) = 0 then 0.0 else coalesce(acc, 0) end as type_accuracy, coalesce(total, 0) >= 3 as applies from f join a using (v) join b using (v) left join ta using (v) left join tn using (v))
select v, dead_f1 >= 0.8 and boundary_f1 >= 0.7 and (not applies or type_accuracy >= 0.7) as passed from m""")
def score_gate(s, d):
    """Type accuracy applies to timelines of three gold spans or more."""
    p, g, t = _pred_gold(s, d)
    dead = scoring.dead_metrics(p.withColumn("ord", F.lit(0)), g.withColumn("ord", F.lit(0)), t).select("v", F.col("f1").alias("dead_f1"))
    bounds = scoring.boundary_metrics(scoring.span_points(p, empty=True), scoring.span_points(g, empty=True), t).select("v", F.col("f1").alias("boundary_f1"))
    r = views.regions(s, d).withColumnRenamed("kind", "type")
    types = scoring.type_accuracy(r.filter("ord % 2 = 0").withColumn("end", F.col("end") - 1), r.filter("ord % 2 = 1"), t).select("v", F.col("accuracy").alias("type_accuracy"), (F.col("total") >= 3).alias("applies_type_accuracy"))
    dead, bounds, types = (staged(x, "scores") for x in (dead, bounds, types))  # or one task holds the sorts of all three
    both = dead.join(bounds, "v").join(types, "v").withColumns({"applies_dead_f1": F.lit(True), "applies_boundary_f1": F.lit(True)})
    return scoring.gate(both).select("v", "passed")


def _category_sql(e: str) -> str:
    kw = " ".join(f"when contains({e}, '{w}') then '{c}'" for w, c in sc.KEYWORDS)
    return f"case when {e} = '' then 'other' when {e} in ({', '.join(repr(c) for c in sc.CATEGORIES)}) then {e} {kw} else 'other' end"


@query(f"""select doc_id, {_category_sql("lower(trim(coalesce(text, '')))")} as category from documents""")
def categories(s, d):
    return views.read(s, d, "documents").select("doc_id", sc.category(F.col("text")).alias("category"))


@query("""select p_partkey, case when length(regexp_replace(c, '[^\\p{L}]', '', 'g')) = 0 then false else length(trim(c)) <= 60 and length(regexp_replace(c, '[^\\p{Lu}]', '', 'g'))::double / length(regexp_replace(c, '[^\\p{L}]', '', 'g')) >= 0.7 end as card
from (select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as c from part)""")
def title_cards(s, d):
    p = views.read(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("c"))
    return p.select("p_partkey", sc.title_card(F.col("c")).alias("card"))


EXT = ", ".join(repr(e) for e in sc.VIDEO_EXTENSIONS)
KEYED = "(select page_id, 'video/' || regexp_replace(url, '[?#:]', '', 'g') || (['.mp4', '.txt', '.MOV', '.x.mkv'])[page_id % 4 + 1] as key, page_id * 100000 as size, case when page_id % 7 = 0 then 'ObjectCreated:Copy' else 'ObjectCreated:Put' end as event from pages)"


def _keys(s, d):
    end = F.element_at(F.array(*map(F.lit, (".mp4", ".txt", ".MOV", ".x.mkv"))), (F.col("page_id") % 4 + 1).cast("int"))
    return views.read(s, d, "pages").select("page_id", F.concat(F.lit("video/"), F.regexp_replace("url", "[?#:]", ""), end).alias("key"), (F.col("page_id") * 100000).alias("size"), F.when(F.col("page_id") % 7 == 0, "ObjectCreated:Copy").otherwise("ObjectCreated:Put").alias("event"))


@query(f"""select page_id, regexp_replace(regexp_replace(key, '^.*/', ''), '\\.[^.]*$', '') as stem, 'segment/' || regexp_replace(regexp_replace(key, '^.*/', ''), '\\.[^.]*$', '') || '.json' as target, '.' || regexp_extract(lower(key), '([^./]+)$', 1) in ({EXT}) as is_video,
case regexp_extract(lower(key), '([^./]+)$', 1) when 'mp4' then 'mp4' when 'mov' then 'mp4' end as format from {KEYED}""")
def file_names(s, d):
    k = F.col("key")
    return _keys(s, d).select("page_id", sc.stem(k).alias("stem"), sc.segment_key(k).alias("target"), sc.is_video_file(k).alias("is_video"), sc.media_format(k).alias("format"))


@query(f"""select page_id, case when event like '%Copy%' then 'skip_copy' when key not like 'video/%' then 'skip' when size < 1048576 then 'reject_size' when not ('.' || regexp_extract(lower(key), '([^./]+)$', 1) in ({EXT})) then 'reject_type' else 'process' end as route from {KEYED}""")
def route_events(s, d):
    return events.route_events(_keys(s, d)).select("page_id", "route")


@query(f"""with k as {KEYED}, n as (select regexp_replace(regexp_replace(key, '^.*/', ''), '\\.[^.]*$', '') as id, size as size_bytes from k where event not like '%Copy%' and size >= 1048576 and '.' || regexp_extract(lower(key), '([^./]+)$', 1) in ({EXT})),
old as (select id from n where size_bytes % 300000 = 0) select id, count(distinct id) as n from n where id not in (select id from old) group by id""")
def insert_if_absent(s, d):
    rows = events.catalogue_rows(events.route_events(_keys(s, d)))
    old = rows.filter("size_bytes % 300000 = 0").select("id")
    return events.insert_if_absent(rows, old).groupBy("id").agg(F.count("*").alias("n"))


@query("""select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type""")
def dedupe_first(s, d):
    e = views.read(s, d, "events").withColumn("name", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return events.dedupe_first(e, F.col("name"), "event_id").select("user_id", "event_type", "event_id")


@query("""select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as n from events) where (n - 1) % 10 = 0""")
def systematic_sample(s, d):
    return events.systematic_sample(views.read(s, d, "events"), "event_id", 10, "user_id").select("user_id", "event_id")


@query("""select event_type, count(*) as n from events group by event_type""")
def status_counts(s, d):
    return events.status_counts(views.read(s, d, "events"), "event_type")


def _clock_sql(t: str) -> str:
    return f"printf('%02d:%02d:%06.3f', (floor({t}) // 3600)::bigint, (floor({t})::bigint % 3600) // 60, {t} - floor({t} / 60) * 60)"


@query(f"""with {TURNS}, n as (select *, row_number() over (partition by v order by "start", ord) as n from turns)
select v, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {_clock_sql('"start"')} || ' --> ' || {_clock_sql('"end"')} || chr(10) || '<v ' || speaker || '>' || text || chr(10), chr(10) order by n) as vtt from n group by v""")
def vtt_text(s, d):
    return documents.vtt_text(views.turns(s, d))


@query()
def turn_windows(s, d):
    return folds.turn_windows(views.turns(s, d), 600, 0.2)


@query(f"""with recursive {TURNS}, f as (select v, ord, length(text) % 4 + 1 as frames, row_number() over (partition by v order by ord) as k from turns),
walk as (select v, ord, frames, k, 0 as batch, 1 as n, frames as used from f where k = 1 union all
 select f.v, f.ord, f.frames, f.k, case when w.n >= 5 or w.used + f.frames > 18 then w.batch + 1 else w.batch end, case when w.n >= 5 or w.used + f.frames > 18 then 1 else w.n + 1 end, case when w.n >= 5 or w.used + f.frames > 18 then f.frames else w.used + f.frames end from walk w join f on f.v = w.v and f.k = w.k + 1)
select v, ord, frames::bigint as frames, batch from walk""")
def shot_batches(s, d):
    t = views.turns(s, d)
    return folds.batch_shots(t.select("v", "ord", (F.length("text") % 4 + 1).alias("frames")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Queries on speaker intervals, enrolment, logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from brolga.functions.intervals import merge_spans
from brolga.operators import audit, diarize, enroll, graph, report
from brolga.plans.common import FRAMES, INTERVALS, r, rounded
from brolga.sources.adapters import frames, intervals, pool, regions, table, vad_probs

VAD = """vad as (select user_id as file_index, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, coalesce(cast(props ->> '$.k' as double) / 100, 0) as prob from events)"""


def _islands(source, start, end, cond, out, keys="file_index"):
    """Intervals of `source` joined while cond (on start and the reach so far) holds."""
    return f"""{out}_0 as (select *, max({end}) over (partition by {keys} order by {start}, {end} rows between unbounded preceding and 1 preceding) as reach from {source} where {end} > {start}),
{out}_1 as (select *, cast(sum(case when reach is null or not ({cond}) then 1 else 0 end) over (partition by {keys} order by {start}, {end}) as bigint) as run from {out}_0),
{out} as (select {keys}, run, min({start}) as {start}, max({end}) as {end}, count(*) as n_merged from {out}_1 group by {keys}, run)"""


def speech_segments(spark, d):
    return diarize.speech_segments(vad_probs(spark, d))


_VAD_RUNS = f"""{VAD}, la as (select file_index, (max(idx) + 1) * 512 * 1000 // 16000 as audio_ms from vad group by 1),
ru as (select file_index, min(idx) * 512 * 1000 // 16000 as start_ms, (max(idx) + 1) * 512 * 1000 // 16000 as end_ms from (select *, idx - row_number() over (partition by file_index order by idx) as g from vad where prob >= 0.5) group by file_index, g),
{_islands("ru", "start_ms", "end_ms", "start_ms < reach + 100", "jo")},
pa as (select jo.file_index, greatest(0, start_ms - 30) as start_ms, least(audio_ms, end_ms + 30) as end_ms from jo join la using (file_index) where end_ms - start_ms >= 250),
{_islands("pa", "start_ms", "end_ms", "start_ms <= reach", "speech")}"""
SPEECH = f"""with {_VAD_RUNS} select file_index, start_ms, end_ms from speech"""


def region_merge(spark, d):
    rows = intervals(spark, d).select((F.col("file_index") % 5).alias("file_index"), "start_ms", "end_ms")
    return merge_spans(rows, ["file_index"])


MERGE = f"""with {INTERVALS}, five as (select file_index % 5 as file_index, start_ms, end_ms from intervals), {_islands("five", "start_ms", "end_ms", "start_ms <= reach", "mg")}
select file_index, start_ms, end_ms, n_merged from mg"""


def _durations(spark, d):
    return intervals(spark, d).groupBy("file_index").agg(F.max("end_ms").cast("long").alias("duration_ms"))


DUR = f"""{INTERVALS}, dur as (select file_index, max(end_ms) as duration_ms from intervals group by 1),
plan as (select file_index, unnest(case when duration_ms < 5000 then [0] else range(0, (duration_ms - 5000) // 1000 * 1000 + 1, 1000) end) as start_ms, duration_ms from dur where duration_ms > 0),
spans as (select file_index, start_ms, least(start_ms + 5000, duration_ms) as end_ms from plan)"""


def window_plan(spark, d):
    speech = intervals(spark, d).where("label = 'user'").select("file_index", "start_ms", "end_ms")
    rows = diarize.split_by_speech(diarize.window_plan(_durations(spark, d)), speech)
    return rows.select("file_index", "start_ms", "end_ms", F.col("covered_ms").cast("long").alias("covered_ms"), "scored")


PLAN = f"""with {DUR}, cv as (select s.file_index, s.start_ms, s.end_ms, sum(least(s.end_ms, i.end_ms) - greatest(s.start_ms, i.start_ms)) as c from spans s join intervals i on i.file_index = s.file_index and i.label = 'user'
  and i.start_ms < s.end_ms and s.start_ms < i.end_ms group by 1, 2, 3)
select s.file_index, s.start_ms, s.end_ms, cast(coalesce(c, 0) as bigint) as covered_ms, coalesce(c, 0) / (s.end_ms - s.start_ms) >= 0.2 as scored from spans s left join cv on cv.file_index = s.file_index and cv.start_ms = s.start_ms"""


def near_speech(spark, d):
    points = regions(spark, d).select("file_index", F.col("start_ms").alias("t"))
    return diarize.near_spans(points, intervals(spark, d).where("label = 'assistant'").select("file_index", "start_ms", "end_ms"), ["file_index"])


NEAR = f"""with {INTERVALS}, p as (select file_index, start_ms + 500 as t from intervals where turn % 3 = 0)
select p.file_index, t, exists (select 1 from intervals i where i.file_index = p.file_index and label = 'assistant' and t between i.start_ms - 50 and i.end_ms + 50) as near from p"""


def profile_scores(spark, d):
    p = pool(spark, d)
    prof = diarize.weighted_profile(p.where("kind in (0, 1)"), ["kind"])
    rows = diarize.similarity(p, "vector", prof.where("kind = 0"), prof.where("kind = 1"))
    return rounded(rows.select("vec_id", "s_target", "s_interviewer"), 5)


_PROF = """el as (select vec_id, label as kind, 2000 + (vec_id % 7) * 1000 as dms, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as dd from embeddings),
pr as (select kind, dd, sum(dms * x) / sum(dms) as m from el where kind in (0, 1) group by 1, 2), pl as (select kind, sqrt(sum(m * m)) as l from pr group by 1),
vl as (select vec_id, sqrt(sum(x * x)) as l from el group by 1)"""
SCORES = f"""with {_PROF}, dt as (select vec_id, pr.kind, sum(x * m) as s from el join pr on pr.dd = el.dd group by 1, 2),
cs as (select dt.vec_id, dt.kind, s / (vl.l * pl.l) as c from dt join vl using (vec_id) join pl on pl.kind = dt.kind)
select vec_id, {r("max(case when kind = 0 then c end)", 5)} as s_target, {r("max(case when kind = 1 then c end)", 5)} as s_interviewer from cs group by 1"""


def leave_one_out(spark, d):
    return rounded(diarize.leave_one_out(pool(spark, d), ["kind"]).select("vec_id", "loo"), 5)


LOO = f"""with {_PROF}, tt as (select kind, dd, sum(dms * x) as t from el group by 1, 2), rs as (select el.vec_id, x, t - dms * x as o from el join tt on tt.kind = el.kind and tt.dd = el.dd)
select vec_id, {r("sum(x * o) / (sqrt(sum(x * x)) * sqrt(sum(o * o)))", 5)} as loo from rs group by 1"""


def pair_variance(spark, d):
    return rounded(diarize.pair_variance(pool(spark, d), ["kind"]))


PAIRS = f"""with e as (select vec_id, label as kind, embedding::double[] as v from embeddings), p as (select a.kind, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.kind = b.kind and a.vec_id < b.vec_id)
select kind, n, {r("avg(c)")} as mean, {r("var_pop(c)")} as variance from p join (select label as kind, count(*) as n from embeddings group by 1) using (kind) group by 1, 2"""


def _tiers(spark, d):
    """Turns as scored blocks: scores from the turn's place, thresholds as given."""
    dur = _durations(spark, d)
    plan = diarize.window_plan(dur)
    h = lambda m: F.pmod(F.col("file_index") * 31 + F.floor(F.col("start_ms") / 1000) * m, F.lit(100)) / 100.0
    scores = plan.withColumns({"s_target": h(17), "s_interviewer": h(7)})
    return diarize.tiers(diarize.blocks(scores, dur), F.lit(0.55), F.lit(0.45))


TIERS = f"""{DUR}, sc as (select *, (file_index * 31 + start_ms // 1000 * 17) % 100 / 100e0 as st, (file_index * 31 + start_ms // 1000 * 7) % 100 / 100e0 as si from spans),
bl as (select file_index, unnest(range(0, duration_ms // 1000)) as block from dur),
md as (select bl.file_index, bl.block, median(st) as s_target, median(si) as s_interviewer from bl left join sc on sc.file_index = bl.file_index and sc.start_ms <= bl.block * 1000 and sc.end_ms >= bl.block * 1000 + 1000 group by 1, 2),
tiers as (select *, case when s_target is null then 'SKIPPED' when s_target > 0.55 then case when s_target - s_interviewer > 0.15 then 'HIGH' else 'MEDIUM' end when s_target > 0.45 then 'MEDIUM' when s_target >= 0.2 then 'SUB' else 'REJECT' end as tier,
  coalesce(s_target > 0.55 and not (s_target - s_interviewer > 0.15), false) as margin_failed from md)"""


def block_tiers(spark, d):
    return rounded(_tiers(spark, d))


BLOCK_TIERS = f"""with {TIERS} select file_index, block, {r("s_target")} as s_target, {r("s_interviewer")} as s_interviewer, tier, margin_failed from tiers"""


def high_runs(spark, d):
    return diarize.high_runs(_tiers(spark, d)).drop("run")


_RUNS = f"""{TIERS}, hr as (select file_index, min(block) as first_block, max(block) as last_block, count(*) as n from (select *, block - row_number() over (partition by file_index order by block) as g from tiers where tier = 'HIGH') group by file_index, g)"""
RUNS = f"""with {_RUNS} select * from hr"""


def tier_counts(spark, d):
    return diarize.tier_counts(_tiers(spark, d))


COUNTS = f"""with {TIERS} select file_index, {", ".join(f"count(case when tier = '{t}' then 1 end) as {t}" for t in ("HIGH", "MEDIUM", "SUB", "REJECT", "SKIPPED"))} from tiers group by 1"""


def activity_levels(spark, d):
    out = diarize.activity(_tiers(spark, d), intervals(spark, d).where("label <> 'system'"))
    return rounded(out.select("file_index", F.col("high_ms").cast("long").alias("high_ms"), F.col("speech_ms").cast("long").alias("speech_ms"), "ratio", "level", F.col("unattributed_ms").cast("long").alias("unattributed_ms")))


ACTIVITY = f"""with {TIERS}, h as (select file_index, count(case when tier = 'HIGH' then 1 end) * 1000 as high_ms from tiers group by 1), s as (select file_index, cast(sum(end_ms - start_ms) as bigint) as sp from intervals where label <> 'system' group by 1),
j as (select h.file_index, high_ms, coalesce(sp, 0) as speech_ms, high_ms / nullif(coalesce(sp, 0), 0) as ratio from h left join s using (file_index))
select file_index, high_ms, speech_ms, {r("ratio")} as ratio, case when ratio is null then 'NO_SPEECH' when ratio > 0.25 then 'NORMAL' when ratio >= 0.1 then 'LOW' else 'VERY_LOW' end as level, greatest(0, speech_ms - high_ms) as unattributed_ms from j"""


def _clean(spark, d):
    runs = diarize.high_runs(_tiers(spark, d)).select("file_index", "run", (F.col("first_block") * 1000).alias("start_ms"), ((F.col("last_block") + 1) * 1000).alias("end_ms"))
    return diarize.contaminated(diarize.run_blocks(runs), regions(spark, d))


def clean_segments(spark, d):
    """The last steps of diarization: blocks that overlaps void, sub-segments, bridged gaps."""
    out = diarize.bridge(diarize.clean_subsegments(_clean(spark, d)), regions(spark, d), _tiers(spark, d))
    return out.select("file_index", "segment", "start_ms", "end_ms", F.col("blocks").cast("long").alias("blocks"), "bridged")


_CLEAN = f"""{_RUNS}, rb as (select hr.file_index, first_block as run, unnest(range(first_block, last_block + 1)) as block from hr), rg as (select file_index, start_ms + 500 as s, end_ms + 500 as e from intervals where turn % 3 = 0),
cb as (select rb.file_index, run, block * 1000 as start_ms, block * 1000 + 1000 as end_ms, (select count(*) from rg where rg.file_index = rb.file_index and rg.s < rb.block * 1000 + 1000 and rb.block * 1000 < rg.e) as hits from rb),
ok as (select file_index, start_ms, end_ms from cb where hits = 0), {_islands("ok", "start_ms", "end_ms", "start_ms <= reach", "sub")}"""


def clean_segment_totals(spark, d):
    seg = diarize.bridge(diarize.clean_subsegments(_clean(spark, d)), regions(spark, d), _tiers(spark, d))
    out = diarize.file_totals(seg, _clean(spark, d))
    return out.select("file_index", "contaminated", F.col("clean_ms").cast("long").alias("clean_ms"), "segments", F.col("bridged").cast("long").alias("bridged"))


CLEAN = f"""with {_CLEAN}, sg as (select file_index, start_ms, end_ms, n_merged, row_number() over (partition by file_index order by start_ms) as segment from sub)
select file_index, cast(segment as bigint) as segment, start_ms, end_ms, n_merged as blocks, cast(0 as bigint) as bridged from sg"""
TOTALS = f"""with {_CLEAN}, a as (select file_index, count(case when hits > 0 then 1 end) as contaminated from cb group by 1), b as (select file_index, cast(sum(end_ms - start_ms) as bigint) as clean_ms, count(*) as segments from sub group by 1)
select a.file_index, contaminated, coalesce(clean_ms, 0) as clean_ms, coalesce(segments, 0) as segments, cast(0 as bigint) as bridged from a left join b using (file_index)"""


def drift_notice(spark, d):
    return rounded(diarize.drift(_tiers(spark, d)))


DRIFT = f"""with {TIERS}, hi as (select *, row_number() over (partition by file_index order by block) as n from tiers where tier = 'HIGH'),
st as (select file_index, avg(case when n <= 30 then s_target end) as mean, avg(s_target) as whole from hi group by 1),
f as (select distinct file_index from tiers), j as (select f.file_index, mean, last_value(whole ignore nulls) over (order by f.file_index rows between unbounded preceding and 1 preceding) as previous from f left join st using (file_index))
select file_index, {r("mean")} as mean, {r("previous")} as previous, coalesce(previous - mean > 0.1, false) as drifted from j"""


def bridged_segments(spark, d):
    """Turns as sub-segments: their pauses of 100 to 300 ms are bridged, longer ones and those that speak for the other are not."""
    sub = intervals(spark, d).select("file_index", F.col("turn").alias("run"), "start_ms", "end_ms", F.lit(1).alias("n_merged")).where("end_ms > start_ms")
    out = diarize.bridge(sub, regions(spark, d), _tiers(spark, d))
    return out.select("file_index", "segment", "start_ms", "end_ms", F.col("blocks").cast("long").alias("blocks"), "bridged")


BRIDGED = f"""with {TIERS}, w as (select file_index, start_ms, end_ms, lag(end_ms) over (partition by file_index order by start_ms, end_ms) as pe from intervals where end_ms > start_ms),
rg as (select file_index, start_ms + 500 as s, end_ms + 500 as e from intervals where turn % 3 = 0 union all
       select file_index, block * 1000, block * 1000 + 1000 from tiers where (tier = 'MEDIUM' and margin_failed) or s_interviewer >= s_target),
st as (select *, pe is not null and start_ms - pe < 400 and (start_ms <= pe or not exists (select 1 from rg where rg.file_index = w.file_index and rg.s < w.start_ms and w.pe < rg.e)) as joins from w),
sg as (select *, sum(case when joins then 0 else 1 end) over (partition by file_index order by start_ms, end_ms) as segment from st)
select file_index, cast(segment as bigint) as segment, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as blocks, count(case when joins then 1 end) as bridged from sg group by 1, 2"""


def chain_check(spark, d):
    return audit.verify_chain(audit.order_log(table(spark, d, "orders")))


CHAIN = """with e as (select o_custkey as log, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as seq, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) as h from orders),
p as (select *, lag(h) over (partition by log order by seq) as real_prev, case when o_orderkey % 1000 = 999 then 'broken' when o_orderkey % 1000 <> 500 then coalesce(lag(h) over (partition by log order by seq), 'genesis') end as prev from e)
select log, count(*) as entries, min(case when prev is distinct from coalesce(real_prev, 'genesis') then seq end) as first_bad from p group by 1"""


def log_order(spark, d):
    return audit.merged_order(table(spark, d, "events"))


LOG_ORDER = """select user_id, event_id, row_number() over (partition by user_id order by ts, event_type, sha256(coalesce(props, '')), event_id) as n from events"""


def peak_envelope(spark, d):
    return rounded(audit.peaks(table(spark, d, "events").select(F.col("user_id").alias("file_index"), F.col("event_id").alias("t_ms"), (F.col("value") * 100).alias("x")), 500), 3)


PEAKS = f"""select user_id as file_index, event_id // 500 as col, {r("max(abs(value * 100)) / 32768", 3)} as peak from events group by 1, 2"""


def timeline_lanes(spark, d):
    return audit.lanes(intervals(spark, d), regions(spark, d), _durations(spark, d))


LANES = f"""with {DUR}, o as (select file_index, duration_ms, cast(coalesce(sum(duration_ms) over (order by file_index rows between unbounded preceding and 1 preceding), 0) as bigint) as off from dur),
l as (select 'turn' as lane, file_index, start_ms, end_ms, label from intervals union all select 'overlap', file_index, start_ms + 500, end_ms + 500, null from intervals where turn % 3 = 0)
select lane, l.file_index, start_ms + off as g0, end_ms + off as g1, label from l join o using (file_index)"""


def gate_results(spark, d):
    p = pool(spark, d)
    prof = diarize.weighted_profile(p.where("kind in (0, 1)"), ["kind"])
    rows = diarize.similarity(p, "vector", prof.where("kind = 0"), prof.where("kind = 1"))
    rows = rows.withColumns({"vad_coverage": (F.col("vec_id") % 10) / 10.0, "closed_share": F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 11) / 10.0)})
    return enroll.triple_gate(rows, seed="s_target", anti="s_interviewer", least_seed=0.25, most_anti=0.3).select("vec_id", "accepted", "failed_gate")


GATES = f"""with {_PROF}, dt as (select vec_id, pr.kind, sum(x * m) as s from el join pr on pr.dd = el.dd group by 1, 2), cs as (select dt.vec_id, dt.kind, s / (vl.l * pl.l) as c from dt join vl using (vec_id) join pl on pl.kind = dt.kind),
g as (select vec_id, max(case when kind = 0 then c end) as t, max(case when kind = 1 then c end) as o, (vec_id % 10) / 10e0 as cov, case when vec_id % 3 > 0 then (vec_id % 11) / 10e0 end as cl from cs group by 1),
f as (select vec_id, case when cov < 0.5 or coalesce(cl < 0.8, false) then 'A' when t < 0.25 then 'B' when o > 0.3 or t - o < 0.15 then 'C' end as failed_gate from g) select vec_id, failed_gate is null as accepted, failed_gate from f"""


def solo_spans(spark, d):
    rows = frames(spark, d).select("file_index", F.round("timestamp").cast("long").alias("t_ms"), ((F.col("is_audio_active") == 1) & (F.col("is_blinking") == 0)).alias("solo"))
    return enroll.solo_spans(rows, step=33.4, least=300)


SOLO = f"""with {FRAMES}, s as (select file_index, round(t)::bigint as t_ms from frames where is_audio_active = 1 and is_blinking = 0),
c as (select *, case when t_ms - lag(t_ms) over w <= 100.2 then 0 else 1 end as ch from s window w as (partition by file_index order by t_ms)), g as (select *, sum(ch) over (partition by file_index order by t_ms rows unbounded preceding) as run from c)
select file_index, min(t_ms) as start_ms, max(t_ms) as end_ms, count(*) as n from g group by file_index, run having max(t_ms) - min(t_ms) >= 300"""


def pool_quality(spark, d):
    return enroll.quality(diarize.pair_variance(pool(spark, d), ["kind"]).join(pool(spark, d).groupBy("kind").agg(F.sum("duration_ms").alias("ms")), "kind")).select("kind", "ms", "quality")


QUALITY = """with e as (select vec_id, label as kind, embedding::double[] as v from embeddings), p as (select a.kind, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.kind = b.kind and a.vec_id < b.vec_id),
v as (select kind, var_pop(c) as vr from p group by 1), m as (select label as kind, cast(sum(2000 + (vec_id % 7) * 1000) as bigint) as ms from embeddings group by 1)
select kind, ms, case when ms >= 45000 and vr <= 0.05 then 'STRONG' when ms >= 20000 then 'MARGINAL' else 'INSUFFICIENT' end as quality from v join m using (kind)"""


def channel_coverage(spark, d):
    return rounded(report.coverage(frames(spark, d), ["macro_motion_energy", "gaze_x", "AU12"]))


COVERAGE = f"""with {FRAMES}, l as (select recording_id, 'macro_motion_energy' as channel, macro_motion_energy as v from frames union all select recording_id, 'gaze_x', gaze_x from frames union all select recording_id, 'AU12', AU12 from frames)
select recording_id, channel, {r("count(v) / count(*)")} as present, case when count(v) = 0 then 'dead' when count(v) * 2 < count(*) then 'low' else 'ok' end as state from l group by 1, 2"""


def clip_activity(spark, d):
    return rounded(report.clip_activity(frames(spark, d)))


CLIP_ACTIVITY = f"""with {FRAMES} select file_index, {r("avg(is_audio_active)")} as active, {r("avg(w)")} as confidence, count(*) as n from frames group by 1"""


def status_summary(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("state"))
    return report.job_status(rows, {"1-URGENT": "active", "2-HIGH": "active", "3-MEDIUM": "queued", "5-LOW": "completed"})


STATUS = """select o_custkey as owner, case o_orderpriority when '1-URGENT' then 'active' when '2-HIGH' then 'active' when '3-MEDIUM' then 'queued' when '5-LOW' then 'completed' else 'failed' end as bucket, count(*) as n from orders group by 1, 2"""


def clip_pairs(spark, d):
    files = table(spark, d, "events").select(F.col("user_id").alias("file_index"), F.when(F.col("event_type") == "error", "MP4").when(F.col("event_type") == "click", "wav").otherwise("txt").alias("ext"))
    return diarize.clip_pairs(files.where("file_index % 4 > 0 or ext <> 'wav'")).select("file_index", "missing")


CLIP_PAIRS = """with f as (select user_id as file_index, case event_type when 'error' then 'mp4' when 'click' then 'wav' else 'txt' end as ext from events where user_id % 4 > 0 or event_type <> 'click'),
p as (select file_index, max(case when ext = 'mp4' then 1 else 0 end) as m, max(case when ext = 'wav' then 1 else 0 end) as w from f group by 1)
select file_index, case when m = 0 and w = 0 then 'mp4,wav' when m = 0 then 'mp4' when w = 0 then 'wav' else '' end as missing from p"""


def chunked(spark, d):
    from brolga.operators.windows import chunk_plan

    rows = chunk_plan(_durations(spark, d), 60_000, 2_000)
    return rows.select("file_index", F.col("chunk").cast("long").alias("chunk"), "start_ms", "end_ms")


CHUNKS = f"""with {DUR}, c as (select file_index, duration_ms, unnest(case when duration_ms <= 60000 then [0] else range(0, duration_ms - 2000, 58000) end) as start_ms from dur where duration_ms > 0)
select file_index, row_number() over (partition by file_index order by start_ms) - 1 as chunk, start_ms, least(start_ms + 60000, duration_ms) as end_ms from c"""


#: The nodes of the queries: face channels, and one that stands for the voice.
_FACE, _VOICE = ("AU12", "AU6", "gaze_x"), ("macro_motion_energy",)


def nodes(rows):
    return graph.standardised(rows, [*_FACE, *_VOICE], _VOICE, _FACE)


_OK = "(v is not null and case when channel = 'macro_motion_energy' then is_audio_active = 1 else coalesce(face_confidence, 0) >= 0.3 end)"


def node_features(spark, d):
    return rounded(nodes(frames(spark, d)))


_NODES = " union all ".join(f"select file_index, idx, recording_id, is_audio_active, face_confidence, '{c}' as channel, {c} as v from frames" for c in ("AU12", "AU6", "gaze_x", "macro_motion_energy"))
NODES = f"""with {FRAMES}, l as ({_NODES}), s as (select recording_id, channel, coalesce(avg(v), 0) as m, case when coalesce(stddev_samp(v), 0) < 1e-8 then 1e0 else stddev_samp(v) end as sd from l group by 1, 2)
select file_index, idx, channel, cast({_OK} as integer) as valid, {r(f"case when {_OK} then (v - m) / sd else 0 end")} as z from l join s using (recording_id, channel)"""


def node_errors(spark, d):
    z = nodes(frames(spark, d))
    return rounded(graph.masked_error(z.withColumn("predicted", F.lit(0.0)), ["file_index", "idx"]))


ERRORS = f"""with {FRAMES}, l as ({_NODES}), s as (select recording_id, channel, coalesce(avg(v), 0) as m, case when coalesce(stddev_samp(v), 0) < 1e-8 then 1e0 else stddev_samp(v) end as sd from l group by 1, 2),
z as (select file_index, idx, {_OK} as ok, (v - m) / sd as z from l join s using (recording_id, channel))
select file_index, idx, {r("coalesce(sum(case when ok then z * z end), 0) / greatest(1, count(case when ok then 1 end))")} as error, count(case when ok then 1 end) as n from z group by 1, 2"""

ALL = {
    "speech_segments": (speech_segments, SPEECH),
    "region_merge": (region_merge, MERGE),
    "window_plan": (window_plan, PLAN),
    "near_speech": (near_speech, NEAR),
    "profile_scores": (profile_scores, SCORES),
    "leave_one_out": (leave_one_out, LOO),
    "pair_variance": (pair_variance, PAIRS),
    "block_tiers": (block_tiers, BLOCK_TIERS),
    "high_runs": (high_runs, RUNS),
    "tier_counts": (tier_counts, COUNTS),
    "activity_levels": (activity_levels, ACTIVITY),
    "clean_segments": (clean_segments, CLEAN),
    "bridged_segments": (bridged_segments, BRIDGED),
    "clean_segment_totals": (clean_segment_totals, TOTALS),
    "drift_notice": (drift_notice, DRIFT),
    "chain_check": (chain_check, CHAIN),
    "log_order": (log_order, LOG_ORDER),
    "peak_envelope": (peak_envelope, PEAKS),
    "timeline_lanes": (timeline_lanes, LANES),
    "gate_results": (gate_results, GATES),
    "solo_spans": (solo_spans, SOLO),
    "pool_quality": (pool_quality, QUALITY),
    "channel_coverage": (channel_coverage, COVERAGE),
    "clip_activity": (clip_activity, CLIP_ACTIVITY),
    "status_summary": (status_summary, STATUS),
    "clip_pairs": (clip_pairs, CLIP_PAIRS),
    "chunk_plan": (chunked, CHUNKS),
    "node_features": (node_features, NODES),
    "node_errors": (node_errors, ERRORS),
}

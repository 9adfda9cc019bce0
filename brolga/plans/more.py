"""Further queries: acoustic blocks, spectra in SQL, report tables, graph windows, enrolment checks, containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from brolga.operators import calibrate, diarize, enroll, evaluate, frames as op, graph, report, windows
from brolga.plans.common import ASSIGNED, FRAMES, INTERVALS, SCORED, r, rounded
from brolga.plans.diarization import _NODES, _OK, nodes, _PROF, _RUNS, _durations, _tiers
from brolga.plans.windows import RECORDING
from brolga.sources.adapters import frames, intervals, pool, regions, scored_windows, table
from brolga.sources.io import split_list_column


def acoustic_windows(spark, d):
    """Latents of a kind 20 ms apart; the codebook is the first eight vectors, loudness the root mean square of first numbers."""
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") * 20.0).alias("center_ms"), F.col("embedding").alias("latent"))
    book = table(spark, d, "embeddings").where("vec_id < 8").select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").alias("centroid"))
    loud = rows.select("label", "center_ms", (F.get("latent", F.lit(0)).cast("double")).alias("x"))
    return rounded(windows.acoustic_block(rows, ["label"], codebook=book, samples=loud, floor=0.12), 5)


_GROUPS16 = ", ".join(f"{r(f'case when on_ then avg(case when dd > {4 * g} and dd <= {4 * g + 4} then x end) end', 5)} as latent_{g}" for g in range(16))
ACOUSTIC = f"""with e as (select label, vec_id, vec_id * 20e0 as c, embedding::double[] as v from embeddings),
book as (select vec_id as code, embedding::double[] as b from embeddings where vec_id < 8),
cd as (select e.vec_id, arg_min(code, (list_distance(v, b), code)) as code from e, book group by 1),
a as (select e.*, code, unnest(range(greatest(0, floor((c - 2000) / 1000) + 1)::bigint, floor(c / 1000)::bigint + 1)) as k from e join cd using (vec_id)),
rm as (select label, k, count(*) as n, sqrt(avg(v[1] * v[1])) as rms from a group by 1, 2),
s as (select *, lag(v) over (partition by label, k order by c) as p from a), st as (select label, k, avg(case when p is not null then 1 - list_cosine_similarity(v, p) end) as step from s group by 1, 2),
en as (select label, k, log2(sum(m)) - sum(m * log2(m)) / sum(m) as entropy from (select label, k, code, count(*)::double as m from a group by 1, 2, 3) group by 1, 2),
x as (select a.label, a.k, unnest(v) as x, unnest(range(1, 65)) as dd from a), vr as (select label, k, dd, var_samp(x) as v from x group by 1, 2, 3), sp as (select label, k, sqrt(sum(v * v)) as spread from vr group by 1, 2),
o as (select rm.*, n > 1 and rms >= 0.12 as on_ from rm),
gr as (select o.label, o.k, {_GROUPS16} from o join x on x.label = o.label and x.k = o.k group by o.label, o.k, on_)
select o.label, o.k, n, {r("case when on_ then spread end", 5)} as spread, {r("case when on_ then step end", 5)} as step, {", ".join(f"latent_{g}" for g in range(16))},
  {r("case when on_ then entropy end", 5)} as entropy, {r("case when on_ then rms end", 5)} as rms
from o join st using (label, k) join sp using (label, k) join en using (label, k) join gr using (label, k)"""


def gaze_spectrum(spark, d):
    rows = windows.spectra(frames(spark, d), channels=("gaze_x",)).drop("recording_id")
    return rounded(rows, 6)


_BANDS = {"tremor": (4, 10), "sway": (0.5, 2)}
SPECTRUM = f"""with {FRAMES}, sp as (select file_index, unnest(range(0, ceil(max(t) / 1000)::bigint)) as k from frames group by 1),
x as (select sp.file_index, sp.k, gaze_x as v, row_number() over (partition by sp.file_index, sp.k order by t) - 1 as i, count(*) over (partition by sp.file_index, sp.k) as n
      from sp join frames f on f.file_index = sp.file_index and f.t >= greatest(0, sp.k * 1000 - 2000) and f.t < sp.k * 1000 + 2000),
l as (select file_index, k, regr_slope(v, i) as b, regr_intercept(v, i) as a from x group by 1, 2),
y as (select x.file_index, x.k, n, i, (v - a - b * i) * (0.5e0 - 0.5e0 * cos(2 * pi() * i / (n - 1))) as y from x join l on l.file_index = x.file_index and l.k = x.k where n >= 8),
f as (select *, unnest(range(1, 61)) as j from y), g as (select *, j * (1e0 / (n * (1e0 / 30))) as hz from f where 2 * j <= n),
p as (select file_index, k, n, j, hz, 2e0 / (n * 30) * (pow(sum(y * cos(2 * pi() * j * i / n)), 2) + pow(sum(y * sin(2 * pi() * j * i / n)), 2)) as p from g where hz <= 10.5 group by file_index, k, n, j, hz),
{", ".join(f"{b} as (select file_index, k, case when sum(p) < 1e-9 then 0 else sum(p) * any_value(1e0 / (n * (1e0 / 30))) end as power, case when sum(p) >= 1e-9 then arg_max(hz, p) end as peak, case when sum(p) >= 1e-9 then log2(sum(p)) - sum(p * log2(p)) / sum(p) end as entropy from p where hz >= {lo} and hz <= {hi} group by 1, 2)" for b, (lo, hi) in _BANDS.items())}
select sp.file_index, sp.k as window_id, {", ".join(f"{r(f'{b}.{m}')} as gaze_x_{b}_{m}" for b in _BANDS for m in ("power", "peak", "entropy"))}
from sp left join tremor on tremor.file_index = sp.file_index and tremor.k = sp.k left join sway on sway.file_index = sp.file_index and sway.k = sp.k"""


def window_fusion(spark, d):
    """Row blocks of two logs met by window number."""
    rows = frames(spark, d)
    a = op.block_windows(rows).select("file_index", "window_id", "AU12_mean")
    b = windows.complete_windows(rows).select("file_index", "window_id", F.col("n").alias("frames"))
    return rounded(a.join(b, ["file_index", "window_id"]))


FUSED = f"""with {ASSIGNED}, b as (select file_index, wd as window_id, avg(AU12) as m from (select *, (row_number() over (partition by file_index order by t) - 1) // 60 as wd from frames) group by 1, 2 having count(*) = 60),
c as (select file_index, k, count(*) as n, any_value(mt) as mt from assigned group by 1, 2), d as (select file_index, n, row_number() over (partition by file_index order by k) - 1 as window_id from c where k * 1000 + 2000 <= mt)
select b.file_index, b.window_id, {r("m")} as AU12_mean, n as frames from b join d on d.file_index = b.file_index and d.window_id = b.window_id"""


def attenuated(spark, d):
    rows = table(spark, d, "events").select("event_id", F.floor("value").cast("short").alias("x"), F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("in_speech"))
    return op.attenuate(rows).select("event_id", F.col("x").cast("int").alias("x"))


ATTENUATED = """select event_id, case when event_type = 'view' then floor(value)::integer else trunc(floor(value) * 0.05e0)::integer end as x from events"""


def list_columns(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("au"))
    return rounded(split_list_column(rows, "au", 64, "AU"), 3)


LISTS = f"""select vec_id, {", ".join(f"{r(f'embedding[{k + 1}]::double', 3)} as AU_{k}" for k in range(64))} from embeddings"""


def baseline_sanity(spark, d):
    return rounded(report.baseline_sanity(calibrate.recording_job(frames(spark, d)), 6))


_DV = RECORDING[: RECORDING.index(",\ndur as")]
SANITY = f"""{_DV}, b as (select dv.recording_id, median(dm) as m from dv join fst on fst.recording_id = dv.recording_id and f = file_index group by 1)
select recording_id, {r("m")} as median_deviation, {r("sqrt(6)")} as expected, m < 0.25 * sqrt(6) as degenerate from b"""


def flagged_windows(spark, d):
    rows = calibrate.recording_job(frames(spark, d))
    out = report.flagged(rows, [f"{c}_mean" for c in windows.Sliding().channels], top=2)
    return rounded(out.select("recording_id", F.col("window_id").cast("long").alias("window_id"), "channel", "z", F.col("place").cast("long").alias("place")), 5)


FLAGGED = f"""{_DV}, nm as (select *, row_number() over (partition by recording_id order by file_index, window_id) - 1 as no,
  (rank() over (partition by recording_id order by round(dm, 6)) + (count(*) over (partition by recording_id, round(dm, 6)) - 1) / 2e0) / count(dm) over (partition by recording_id) as pct from dv),
zz as (select nm.recording_id, no, z.channel, case when usable then z.z else z.value end as z from nm join z on z.file_index = nm.file_index and z.window_id = nm.window_id where pct >= 0.95),
k as (select *, row_number() over (partition by recording_id, no order by round(abs(z), 6) desc, channel) as place from zz where z is not null)
select recording_id, no as window_id, channel, {r("z", 5)} as z, place from k where place <= 2"""


def channel_groups(spark, d):
    rows = calibrate.recording_job(frames(spark, d)).unpivot(["recording_id"], [f"{c}_mean" for c in windows.Sliding().channels], "channel", "z").where("z is not null")
    return rounded(report.channel_groups(rows, {"AU": "face", "gaze": "gaze"}), 5)


GROUPS = f"""{_DV}, cm as (select recording_id, channel, case when channel like 'AU%' then 'face' when channel like 'gaze%' then 'gaze' else 'other' end as grp, median(case when usable then z else value end) as m from z group by 1, 2, 3)
select recording_id, grp, {r("median(m)", 5)} as median, max_by(channel, (abs(m), channel)) as top from cm where m is not null group by 1, 2"""


def window_lookup(spark, d):
    w = windows.spine(frames(spark, d)).select("recording_id", "file_index", F.col("k").alias("window_id"), (F.col("k") * 1000.0).alias("start_time_ms"), (F.col("k") * 1000.0 + 2000).alias("end_time_ms"))
    return report.window_at(w, F.lit(7000.0)).select("file_index", "window_id")


LOOKUP = f"""with {FRAMES}, sp as (select file_index, unnest(range(0, ceil(max(t) / 1000)::bigint)) as k from frames group by 1) select file_index, min(k) as window_id from sp where k * 1000 <= 7000 and 7000 <= k * 1000 + 2000 group by 1"""


def session_counts(spark, d):
    rows = frames(spark, d)
    w = windows.spine(rows).groupBy("recording_id").agg(F.count("*").alias("windows"))
    return rows.groupBy("recording_id").agg(F.count("*").alias("frames"), F.countDistinct("file_index").alias("clips")).join(w, "recording_id")


SESSION = f"""with {FRAMES}, c as (select recording_id, file_index, ceil(max(t) / 1000)::bigint as w, count(*) as n from frames group by 1, 2)
select recording_id, cast(sum(n) as bigint) as frames, count(*) as clips, cast(sum(w) as bigint) as windows from c group by 1"""


def labelled_windows(spark, d):
    w = scored_windows(spark, d).select("subject", "clip", "window_id", "label", (F.col("window_id") * 1000 + F.col("clip") * 77).alias("start_ms"))
    out = evaluate.labelled_windows(w, w.where("clip % 5 <> 2").select("subject", "clip"))
    return out.groupBy("subject", "clip").agg(F.count("*").alias("n"), F.max("local_ms").alias("last_ms"))


LABELLED = f"""with {SCORED}, b as (select subject, min(clip) as base from scored group by 1) select s.subject, clip, count(*) as n, max(window_id) * 1000 as last_ms from scored s join b on b.subject = s.subject and clip <> base where clip % 5 <> 2 group by 1, 2"""


def model_windows(spark, d):
    z = nodes(frames(spark, d))
    out = graph.temporal_split(graph.model_windows(z, least=0.45))
    return out.select("file_index", F.col("window").cast("long").alias("window"), F.col("valid").cast("long").alias("valid"), "train")


MODEL_WINDOWS = f"""with {FRAMES}, l as ({_NODES}), n as (select file_index, max(idx) + 1 as n from frames group by 1), v as (select l.file_index, idx, cast({_OK} as integer) as ok, n from l join n on n.file_index = l.file_index),
a as (select *, unnest(range(greatest(0, floor((idx - 90) / 15e0) + 1)::bigint, idx // 15 + 1)) as w from v), g as (select file_index, w, sum(ok) as valid from a where w * 15 + 90 <= n group by 1, 2 having sum(ok) >= 0.45 * 90 * 4)
select file_index, w as window, cast(valid as bigint) as valid, row_number() over (partition by file_index order by w) <= floor(count(*) over (partition by file_index) * 0.8e0) as train from g"""


_RESIDUAL_NODES = ("AU12", "AU6", "gaze_x", "macro_motion_energy")


def residual_attribution(spark, d):
    """Errors of predicting nothing, in windows of 60 rows, against those of the first clip of the own recording, by node and as a whole."""
    rows = frames(spark, d)
    err = graph.masked_error(nodes(rows).withColumn("predicted", F.lit(0.0)))
    told = lambda e: e.groupBy((F.col("file_index") % 10).alias("recording_id"), "file_index", F.floor(F.col("idx") / 60).alias("window"), F.col("channel").alias("node")).agg(F.avg("error").alias("error"))
    # a clip is of one recording; which is the first needs no windows, and windows of the others need not be summed for it
    first = rows.where("recording_id is not null and file_index is not null").select("recording_id", "file_index").distinct().groupBy("recording_id").agg(F.min("file_index").alias("file_index"))
    out = graph.residual_table(told(err), told(err.join(first.select("file_index"), "file_index")), ["file_index", "window"], ["recording_id"])
    return rounded(out.select("file_index", "window", *[F.col("coupling_z")[n].alias(f"z_{n}") for n in _RESIDUAL_NODES], "global_z", "max_z"), 5)


_Z = ", ".join(f"{r(f'max(case when channel = {chr(39)}{n}{chr(39)} then z end)', 5)} as z_{n}" for n in _RESIDUAL_NODES)
RESIDUAL = f"""with {FRAMES}, l as ({_NODES}), s as (select recording_id, channel, coalesce(avg(v), 0) as m, case when coalesce(stddev_samp(v), 0) < 1e-8 then 1e0 else stddev_samp(v) end as sd from l group by 1, 2),
e as (select file_index, idx, channel, case when {_OK} then pow((v - m) / sd, 2) else 0 end as e from l join s using (recording_id, channel)),
w as (select file_index, idx // 60 as win, channel, avg(e) as e from e group by 1, 2, 3), f as (select file_index % 10 as rec, min(file_index) as file_index from w group by 1),
b as (select rec, channel, avg(e) as m, stddev_pop(e) + 1e-6 as s from w join f using (file_index) group by 1, 2), z as (select file_index, win, w.channel, (e - m) / s as z from w join b on b.rec = w.file_index % 10 and b.channel = w.channel)
select file_index, win as "window", {_Z}, {r("sum(z)", 5)} as global_z, {r("max(z)", 5)} as max_z from z group by 1, 2"""


MODELLED = ("AU12", "AU6", "macro_motion_energy")


def neighbour_models(spark, d):
    """Ridge models of three channels on one another, by recording."""
    return rounded(graph.neighbour_models(frames(spark, d), list(MODELLED), ["recording_id"]))


def _ridge(y, a, b):
    """Weights of a and b for y in closed form, from correlations."""
    ra, rb, rab = f"corr({y}, {a})", f"corr({y}, {b})", f"corr({a}, {b})"
    det = f"(1.21e0 - {rab} * {rab})"
    wa, wb = f"(1.1e0 * {ra} - {rab} * {rb}) / {det} * stddev_pop({y}) / stddev_pop({a})", f"(1.1e0 * {rb} - {rab} * {ra}) / {det} * stddev_pop({y}) / stddev_pop({b})"
    return [(y, a, wa), (y, b, wb), (y, "(intercept)", f"avg({y}) - {wa} * avg({a}) - {wb} * avg({b})")]


_WEIGHTS = [w for k, y in enumerate(MODELLED) for w in _ridge(y, *[x for x in MODELLED if x != y])]
NEIGHBOURS = f"""with {FRAMES}, c as (select * from frames where {" and ".join(f"{x} is not null" for x in MODELLED)}),
w as ({" union all ".join(f"select recording_id, '{y}' as channel, '{x}' as neighbour, {w} as weight from c group by 1" for y, x, w in _WEIGHTS)})
select recording_id, channel, neighbour, {r("weight")} as weight from w"""


def model_health(spark, d):
    """Loss of what the neighbours tell of each clip's AU12, against that of telling its mean, both weighted by confidence."""
    rows = frames(spark, d)
    told = graph.predicted(rows, graph.neighbour_models(rows, list(MODELLED), ["recording_id"]), list(MODELLED), ["recording_id"])
    mean = rows.groupBy("recording_id").agg(F.avg("AU12").alias("_mean"))
    told = told.join(mean, "recording_id").select("file_index", "idx", F.col("AU12").alias("z"), F.col("predicted_AU12").alias("p"), "_mean", "joint_confidence", F.col("predicted_AU12").isNotNull().cast("int").alias("valid"))
    loss = lambda x: graph.weighted_loss(graph.masked_error(told.withColumn("predicted", F.col(x)), ["file_index", "idx", "joint_confidence"]), ["file_index"], "joint_confidence", target=True)
    return rounded(graph.coupling_ratio(loss("p"), loss("_mean"), ["file_index"]), 5)


HEALTH = f"""with {FRAMES}, c as (select * from frames where {" and ".join(f"{x} is not null" for x in MODELLED)}),
m as (select recording_id, {", ".join(f"{w} as w{k}" for k, (_, _, w) in enumerate(_WEIGHTS[:3]))} from c group by 1), a as (select recording_id, avg(AU12) as mean from frames group by 1),
e as (select file_index, w, pow(w0 * AU6 + w1 * macro_motion_energy + w2 - AU12, 2) as e, pow(mean - AU12, 2) as e0 from frames join m using (recording_id) join a using (recording_id) where macro_motion_energy is not null and AU6 is not null),
o as (select file_index, sum(e * w) / greatest(sum(w), 1e-6) as loss, sum(e0 * w) / greatest(sum(w), 1e-6) as zero_loss from e group by 1)
select file_index, {r("loss", 5)} as loss, {r("zero_loss", 5)} as zero_loss, {r("loss / nullif(zero_loss, 0)", 5)} as ratio, loss / nullif(zero_loss, 0) < 0.9 as healthy from o"""


def _cosines(spark, d):
    p = pool(spark, d)
    prof = diarize.weighted_profile(p.where("kind in (0, 1)"), ["kind"])
    return diarize.similarity(p, "vector", prof.where("kind = 0"), prof.where("kind = 1"))


_COS = f"""{_PROF}, dt as (select vec_id, pr.kind, sum(x * m) as s from el join pr on pr.dd = el.dd group by 1, 2), cs as (select dt.vec_id, dt.kind, s / (vl.l * pl.l) as c from dt join vl using (vec_id) join pl on pl.kind = dt.kind),
g as (select vec_id, label, max(case when cs.kind = 0 then c end) as t, max(case when cs.kind = 1 then c end) as o from cs join embeddings using (vec_id) group by 1, 2)"""


def score_thresholds(spark, d):
    rows = _cosines(spark, d)
    out = diarize.thresholds(rows.where("kind = 0").select(F.col("s_target").alias("s")), rows.where("kind = 1").select(F.col("s_target").alias("s")))
    return rounded(out, 5)


THRESHOLDS = f"""with {_COS}, a as (select count(*) as n, quantile_cont(t, 0.1) as q10 from g where label = 0), b as (select max(t) as worst from g where label = 1),
h as (select *, case when n >= 10 then case when worst is not null then greatest(q10, worst + 0.05) else greatest(q10, 0.55) end end as raw from a, b),
k as (select *, case when n < 10 then 0.6 else least(greatest(raw, 0.45), 0.75) end as hi from h)
select n, {r("q10", 5)} as q10, {r("worst", 5)} as worst, {r("hi::double", 5)} as theta_high, {r("(case when n < 10 then 0.4 else greatest(hi::double - 0.15e0, 0.3) end)::double", 5)} as theta_med,
  case when n < 10 then 'FALLBACK_DEFAULTS' when worst is not null then 'DERIVED' else 'DERIVED_NO_ANTI' end as calibration, coalesce(raw > 0.75, false) as overlapping from k"""


def anchored_spans(spark, d):
    return enroll.anchored(_cosines(spark, d), least=0.3, most=0.25).groupBy("kind", "reason").agg(F.count("*").alias("n"))


ANCHORED = f"""with {_COS} select label as kind, case when t < 0.3 then 'seed' when o > 0.25 then 'anti' when t - o < 0.15 then 'margin' else 'accepted' end as reason, count(*) as n from g group by 1, 2"""


def pool_growth(spark, d):
    rows = _cosines(spark, d).select(F.col("kind").alias("file_index"), F.col("s_target").alias("sim"), "duration_ms")
    return enroll.grow_pools(rows, 0.1)


GROWTH = f"""with {_COS}, a as (select label, count(*) as n, sum(2000 + (vec_id % 7) * 1000) as ms from g where t >= 0.1 group by 1)
select label as file_index, cast(sum(n) over w as bigint) as n, cast(sum(ms) over w as bigint) as ms from a window w as (order by label)"""


def pooled_profile(spark, d):
    prof = diarize.weighted_profile(pool(spark, d), ["kind"])
    return rounded(prof.select("kind", F.posexplode("profile").alias("d", "x")), 5)


PROFILE = f"""with el as (select label as kind, 2000 + (vec_id % 7) * 1000 as dms, unnest(embedding)::double as x, unnest(range(0, 64)) as dd from embeddings), m as (select kind, dd, sum(dms * x) / sum(dms) as m from el group by 1, 2)
select kind, cast(dd as integer) as d, {r("m / sqrt(sum(m * m) over (partition by kind))", 5)} as x from m"""


def candidate_discards(spark, d):
    spans = intervals(spark, d).where("label = 'user'").select("file_index", "start_ms", "end_ms")
    return enroll.discards(spans, regions(spark, d), 4000)


DISCARDS = f"""with {INTERVALS}, g as (select file_index, start_ms + 500 as s, end_ms + 500 as e from intervals where turn % 3 = 0)
select file_index, start_ms, end_ms, case when exists (select 1 from g where g.file_index = i.file_index and s < end_ms and start_ms < e) then 'seed overlap' when end_ms - start_ms < 4000 then 'too short' end as why from intervals i where label = 'user'"""


def seed_spans(spark, d):
    rows = intervals(spark, d).withColumns({"click_ms": F.col("start_ms") + F.col("turn") * 1500, "other_open": (F.col("turn") % 4) / 10.0})
    return enroll.seed_checks(rows).select("file_index", "turn", "check")


SEED = f"""with {INTERVALS} select file_index, turn, case when start_ms + turn * 1500 >= end_ms then 'click outside' when end_ms - start_ms < 3000 then 'too short' when (turn % 4) / 10e0 > 0.2 then 'other mouth open' else 'ok' end as "check" from intervals"""


def trimmed_runs(spark, d):
    """Runs of the scored turns, their edges refined by fine scores made of the place of each span."""
    runs, dur = diarize.high_runs(_tiers(spark, d)), _durations(spark, d)
    fine = diarize.fine_plan(runs, dur).select("file_index", "start_ms", "end_ms").distinct()
    a, b = F.floor(F.col("start_ms") / 250), F.floor(F.col("end_ms") / 250)
    fine = fine.withColumns(
        {"s_target": (a * 7 + b * 3 + F.col("file_index")) % 10 / 10.0, "s_interviewer": F.when(a % 4 > 0, (a + F.col("file_index")) % 10 / 10.0)}
    )
    out = diarize.edge_trim(runs, dur, fine, 0.5)
    return out.select("file_index", "first_block", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "lead_demoted", "tail_demoted")


TRIMMED = f"""with {_RUNS}, pos as (select hr.*, duration_ms, true as lead, first_block * 1000 + k * 250 as p from hr join dur using (file_index), range(0, 9) t(k) union all
  select hr.*, duration_ms, false, last_block * 1000 + 1000 - k * 250 from hr join dur using (file_index), range(0, 9) t(k)),
span as (select *, greatest(0, case when lead then p else p - 2000 end) as s, least(duration_ms, case when lead then p + 2000 else p end) as e from pos),
fine as (select *, (s // 250 * 7 + e // 250 * 3 + file_index) % 10 / 10e0 as ft, case when s // 250 % 4 > 0 then (s // 250 + file_index) % 10 / 10e0 end as fi from span where e - s >= 1000),
ok as (select * from fine where ft > 0.5 and (fi is null or ft - fi > 0.15)),
f as (select hr.file_index, hr.first_block, hr.last_block, min(case when lead then p end) as fp, max(case when not lead then p end) as lp from hr left join ok on ok.file_index = hr.file_index and ok.first_block = hr.first_block group by 1, 2, 3),
g as (select *, first_block * 1000 as s0, last_block * 1000 + 1000 as e0, coalesce(fp - first_block * 1000 > 750, true) as ld, coalesce(last_block * 1000 + 1000 - lp > 750, true) as tl from f),
h as (select *, case when ld then s0 + 1000 else fp end as start_ms from g), i as (select *, tl and e0 - 1000 > start_ms as td from h),
j as (select *, case when td then e0 - 1000 when tl then e0 else lp end as end_ms from i)
select file_index, first_block, start_ms, end_ms, ld as lead_demoted, td as tail_demoted from j where start_ms < e0 and end_ms > start_ms"""


def clip_clock(spark, d):
    dur = _durations(spark, d).withColumn("recording_id", F.lit(0))
    off = calibrate.file_offsets(dur).select("file_index", "file_offset_ms")
    seg = intervals(spark, d).join(off, "file_index").select("file_index", (F.col("start_ms") + F.col("file_offset_ms") - 150).alias("start_ms"), (F.col("end_ms") + F.col("file_offset_ms")).alias("end_ms"))
    return diarize.to_clip_clock(seg, off)


CLOCK = f"""with {INTERVALS} select file_index, greatest(0, start_ms - 150) as start_ms, greatest(greatest(0, start_ms - 150), end_ms) as end_ms from intervals"""


def containers(spark, d):
    js = F.concat(F.lit('{"start_time":"'), (F.col("o_orderkey") % 1000 / 1000.0).cast("decimal(6,3)").cast("string"), F.lit('","r_frame_rate":"30/1","avg_frame_rate":"'), F.when(F.col("o_orderkey") % 3 == 0, "60/2").otherwise("2997/100"), F.lit('"}'))
    return diarize.container_facts(table(spark, d, "orders").select(F.col("o_orderkey").alias("file_index"), js.alias("probe")))


CONTAINERS = """select o_orderkey as file_index, o_orderkey % 1000 as start_ms, false as start_missing, o_orderkey % 3 <> 0 as variable_rate from orders"""


def stitched(spark, d):
    chunks = windows.chunk_plan(_durations(spark, d), 60_000, 2_000)
    rows = chunks.select("file_index", "chunk", F.explode(F.sequence(F.ceil(F.col("start_ms") / 500), F.ceil(F.col("end_ms") / 500) - 1)).alias("n")).withColumn("center_ms", F.col("n") * 500)
    return diarize.stitch(rows, chunks).groupBy("file_index").agg(F.count("*").alias("n"), F.countDistinct("center_ms").alias("distinct_n"))


STITCHED = f"""with {INTERVALS}, dur as (select file_index, max(end_ms) as m from intervals group by 1) select file_index, ceil(m / 500e0)::bigint as n, ceil(m / 500e0)::bigint as distinct_n from dur where m > 0"""


def stem_mapping(spark, d):
    rows = table(spark, d, "pages").select("page_id", diarize.stem(F.concat(F.lit("/Data/Clip_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "_Canonical_16k.WAV").otherwise("_hubert.mp4"))).alias("stem"))
    return rows


STEMS = """select page_id, 'clip_' || page_id as stem from pages"""

ALL = {
    "acoustic_windows": (acoustic_windows, ACOUSTIC),
    "gaze_spectrum": (gaze_spectrum, SPECTRUM),
    "window_fusion": (window_fusion, FUSED),
    "attenuated_samples": (attenuated, ATTENUATED),
    "list_columns": (list_columns, LISTS),
    "baseline_sanity": (baseline_sanity, SANITY),
    "flagged_windows": (flagged_windows, FLAGGED),
    "channel_groups": (channel_groups, GROUPS),
    "window_lookup": (window_lookup, LOOKUP),
    "session_counts": (session_counts, SESSION),
    "labelled_windows": (labelled_windows, LABELLED),
    "model_windows": (model_windows, MODEL_WINDOWS),
    "residual_attribution": (residual_attribution, RESIDUAL),
    "score_thresholds": (score_thresholds, THRESHOLDS),
    "anchored_spans": (anchored_spans, ANCHORED),
    "neighbour_models": (neighbour_models, NEIGHBOURS),
    "model_health": (model_health, HEALTH),
    "pool_growth": (pool_growth, GROWTH),
    "pooled_profile": (pooled_profile, PROFILE),
    "candidate_discards": (candidate_discards, DISCARDS),
    "seed_spans": (seed_spans, SEED),
    "trimmed_runs": (trimmed_runs, TRIMMED),
    "clip_clock": (clip_clock, CLOCK),
    "container_facts": (containers, CONTAINERS),
    "stitched_chunks": (stitched, STITCHED),
    "stem_mapping": (stem_mapping, STEMS),
}

"""Queries on sliding windows and calibrated recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from brolga.operators import calibrate as cal
from brolga.operators import windows as op
from brolga.plans.common import ASSIGNED, r, rounded
from brolga.sources.adapters import frames

CHANNELS = op.Sliding().channels


def window_features(spark, d):
    return rounded(op.window_table(frames(spark, d)), 9)


def _reg(c):
    return f"case when w < 0.35e0 then {c} * w else {c} end"


def windows_sql(channels):
    """The window table of some channels, as CTEs."""
    stats = ", ".join(
        f"""case when heavy then case when tot_{c} >= 1e-9 then sum_{c} / tot_{c} end end as {c}_mean, case when heavy then max_{c} end as {c}_max, case when heavy then min_{c} end as {c}_min,
    case when heavy and n_{c} >= 2 and tot_{c} >= 1e-9 then greatest(dev_{c} / tot_{c}, 0e0) end as {c}_var"""
        for c in channels
    )
    agg = ", ".join(
        f"""sum(case when {c} is not null then w end) as tot_{c}, sum(w * ({_reg(c)})) as sum_{c}, max({_reg(c)}) as max_{c}, min({_reg(c)}) as min_{c}, count({c}) as n_{c},
    sum(w * (({_reg(c)}) - m_{c}) * (({_reg(c)}) - m_{c})) as dev_{c}"""
        for c in channels
    )
    means = ", ".join(f"sum(w * ({_reg(c)})) over win / nullif(sum(case when {c} is not null then w end) over win, 0) as m_{c}" for c in channels)
    return f"""{ASSIGNED},
m as (select *, {means}, is_blinking - lag(is_blinking) over (partition by file_index, k order by t) as rise from assigned window win as (partition by file_index, k)),
g as (select recording_id, file_index, k, count(*) as frame_count, sum(w) as cw, sum(w) >= 15 as heavy, sum(case when rise = 1 then 1 else 0 end) as blinks,
      sum(w * ({_reg("is_audio_active")})) / nullif(sum(w), 0) as act, {agg} from m group by 1, 2, 3),
md as (select file_index, k, emotion_label, row_number() over (partition by file_index, k order by count(*) desc, emotion_label) as n from assigned group by 1, 2, 3),
sp as (select recording_id, file_index, unnest(range(0, ceil(max(t) / 1000)::bigint)) as k from frames group by 1, 2),
windows as (select sp.recording_id, sp.file_index, sp.k as window_id, sp.k * 1000e0 as start_time_ms, sp.k * 1000e0 + 2000 as end_time_ms, coalesce(frame_count, 0) as frame_count,
      coalesce(cw, 0) as cumulative_confidence, case when heavy then md.emotion_label else 'N/A' end as emotion_label_mode, cast(case when heavy then blinks else 0 end as bigint) as blink_count,
      case when heavy then act end as active_ratio, {stats}
      from sp left join g on g.file_index = sp.file_index and g.k = sp.k left join md on md.file_index = sp.file_index and md.k = sp.k and md.n = 1)"""


WINDOWS = windows_sql(CHANNELS)
WIDE = (*CHANNELS, "AU1", "AU9", "AU25", "AU26")
UNITS = [c for c in WIDE if c.startswith("AU")]

_FEATURES = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "max", "min", "var")]
FEATURES = f"""with {WINDOWS} select recording_id, file_index, window_id, start_time_ms, end_time_ms, frame_count, {r("cumulative_confidence", 9)} as cumulative_confidence,
  emotion_label_mode, blink_count, {r("active_ratio", 9)} as active_ratio, {", ".join(f"{r(f, 9)} as {f}" for f in _FEATURES)} from windows"""


def window_indices(spark, d):
    wide = op.Sliding(channels=WIDE)
    rows = op.indices(op.window_table(frames(spark, d), wide), wide)
    still = op.freeze_index("macro_motion_energy_mean", [f"{c}_var" for c in UNITS])
    gated = op.activity_gate(F.col("AU12_mean"), F.col("active_ratio"))
    return rounded(rows.select("file_index", "window_id", *_INDEX, still.alias("postural_freeze_index"), gated.alias("gated")))


_INDEX = {
    "duchenne_index": "AU6_mean * AU12_mean",
    "cognitive_load_index": "AU4_mean * AU1_mean",
    "speech_hesitation_index": "AU25_mean * AU26_mean",
    "disgust_leak": "AU9_mean * (1 - AU12_mean)",
    "blink_rate": "blink_count / 2e0",
    "active_ms": "active_ratio * 2000",
}
_STILL = f"""case when coalesce({", ".join(f"{c}_var" for c in UNITS)}) is not null then macro_motion_energy_mean * ({" + ".join(f"coalesce({c}_var, 0)" for c in UNITS)}) end"""
_INDEX_SQL = ", ".join(f"{r(x)} as {n}" for n, x in _INDEX.items())
INDICES = f"""with {windows_sql(WIDE)} select file_index, window_id, {_INDEX_SQL}, {r(_STILL)} as postural_freeze_index,
  {r("case when active_ratio is null or active_ratio >= 0.5 then AU12_mean end")} as gated from windows"""


def window_entropy(spark, d):
    return rounded(op.grid_entropy(frames(spark, d), "gaze_x", "gaze_y"))


def _bin(c):
    return f"case when {c} < -0.15e0 then 0 when {c} < 0.15e0 then 1 else 2 end"


ENTROPY = f"""with {ASSIGNED}, c as (select recording_id, file_index, k, {_bin("gaze_x")} * 3 + {_bin("gaze_y")} as cell, count(*) as n from assigned group by 1, 2, 3, 4),
s as (select *, sum(n) over (partition by file_index, k) as total from c) select recording_id, file_index, k, {r("sum(-(n / total) * log2(n / total))")} as entropy from s group by 1, 2, 3"""


def window_complete(spark, d):
    return op.complete_windows(frames(spark, d))


COMPLETE = f"""with {ASSIGNED}, c as (select recording_id, file_index, k, count(*) as n, any_value(mt) as mt from assigned group by 1, 2, 3)
select recording_id, file_index, k, n, row_number() over (partition by recording_id, file_index order by k) - 1 as window_id from c where k * 1000 + 2000 <= mt"""


def window_spectra(spark, d):
    return rounded(op.spectra(frames(spark, d)), 5)


def baseline_stats(spark, d):
    w = op.window_table(frames(spark, d))
    return rounded(cal.fit_baseline(w, [f"{c}_mean" for c in CHANNELS]))


_LONG = " union all ".join(f"select recording_id, file_index, window_id, '{c}_mean' as channel, {c}_mean as value from windows" for c in CHANNELS)
_BASE = f"""{WINDOWS}, lw as ({_LONG}), fst as (select recording_id, min(file_index) as f from windows group by 1),
base as (select lw.recording_id, channel, avg(value) as mean, nullif(stddev_samp(value), 0) as std, count(value) as n from lw join fst on fst.recording_id = lw.recording_id and f = file_index group by 1, 2)"""
BASELINE = f"""with {_BASE} select recording_id, channel, {r("mean")} as mean, {r("std")} as std, n from base"""


def recording_percentiles(spark, d):
    """The recording job: most deviant windows against the baseline clip, on one clock, with their percentile."""
    rows = cal.recording_job(frames(spark, d))
    return rounded(rows.select("recording_id", "file_index", "clip_window_id", F.col("window_id").cast("long").alias("window_id"), "start_time_ms", "deviation_magnitude", "deviation_percentile", "AU12_mean"))


RECORDING = f"""with {_BASE}, z as (select lw.recording_id, file_index, window_id, lw.channel, value, case when mean is not null and std is not null then (value - mean) / std end as z,
  mean is not null and std is not null as usable from lw left join base using (recording_id, channel)),
dv as (select recording_id, file_index, window_id, sqrt(coalesce(sum(z * z), 0)) as dm, max(case when channel = 'AU12_mean' then case when usable then z else value end end) as a12 from z group by 1, 2, 3),
dur as (select recording_id, file_index, max(t) as len from frames group by 1, 2),
off as (select *, coalesce(sum(len) over (partition by recording_id order by file_index rows between unbounded preceding and 1 preceding), 0) as o from dur)
select dv.recording_id, dv.file_index, dv.window_id as clip_window_id, row_number() over (partition by dv.recording_id order by dv.file_index, dv.window_id) - 1 as window_id,
  {r("dv.window_id * 1000e0 + o")} as start_time_ms, {r("dm")} as deviation_magnitude,
  {r("(rank() over (partition by dv.recording_id order by round(dm, 6)) + (count(*) over (partition by dv.recording_id, round(dm, 6)) - 1) / 2e0) / count(dm) over (partition by dv.recording_id)")} as deviation_percentile,
  {r("a12")} as AU12_mean from dv join off on off.file_index = dv.file_index"""


def self_calibrated(spark, d):
    w = op.window_table(frames(spark, d), op.Sliding(digits=9))
    rows = cal.self_calibrate(w, ["AU12_mean", "gaze_x_mean"], until=8000.0)
    return rounded(rows.select("file_index", "window_id", "AU12_mean", "gaze_x_mean", "deviation_magnitude"))


def _z(c):
    return f"({c} - avg(case when early then {c} end) over c) / nullif(stddev_samp(case when early then {c} end) over c, 0)"


def _varying(c):
    mean, std = f"avg(case when early then {c} end) over c", f"stddev_samp(case when early then {c} end) over c"
    return f"case when {std} > 1e-12 * greatest(abs({mean}), 1e0) then ({c} - {mean}) / {std} end"


# weights that come to 15, and a deviation that is 0, are so but for rounding: sums in another order must not tell them apart
SELF = f"""with {WINDOWS.replace("sum(w) >= 15", "round(sum(w), 9) >= 15")}, e as (select *, start_time_ms < 8000 as early from windows),
z as (select file_index, window_id, count(case when early then 1 end) over c as n, AU12_mean, gaze_x_mean, {_varying("AU12_mean")} as za, {_varying("gaze_x_mean")} as zg from e window c as (partition by file_index))
select file_index, window_id, {r("case when n < 2 then AU12_mean else za end")} as AU12_mean, {r("case when n < 2 then gaze_x_mean else zg end")} as gaze_x_mean,
  {r("case when n >= 2 then sqrt(coalesce(za * za, 0) + coalesce(zg * zg, 0)) end")} as deviation_magnitude from z"""


def deviation_ratio(spark, d):
    rows = cal.self_calibrate(op.window_table(frames(spark, d)), ["AU12_mean", "gaze_x_mean"], until=8000.0)
    return rounded(cal.deviation_ratio(rows, 8000.0).drop("recording_id"))


RATIO = f"""with {WINDOWS}, e as (select *, start_time_ms < 8000 as early from windows),
z as (select file_index, early, count(case when early then 1 end) over c as n, {_z("AU12_mean")} as za, {_z("gaze_x_mean")} as zg from e window c as (partition by file_index)),
v as (select file_index, early, case when n >= 2 then sqrt(coalesce(za * za, 0) + coalesce(zg * zg, 0)) end as dm from z),
a as (select file_index, avg(case when early then dm end) as baseline, avg(case when not early then dm end) as test from v group by 1)
select file_index, {r("baseline")} as baseline, {r("test")} as test, {r("test / nullif(baseline, 0)")} as ratio from a"""

ALL = {
    "recording_percentiles": (recording_percentiles, RECORDING),
    "window_features": (window_features, FEATURES),
    "window_indices": (window_indices, INDICES),
    "window_entropy": (window_entropy, ENTROPY),
    "window_complete": (window_complete, COMPLETE),
    "window_spectra": (window_spectra, None),
    "baseline_stats": (baseline_stats, BASELINE),
    "self_calibrated": (self_calibrated, SELF),
    "deviation_ratio": (deviation_ratio, RATIO),
}

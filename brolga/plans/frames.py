"""Queries on frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import entropy
from brolga.functions.intervals import as_of
from brolga.operators import frames as op
from brolga.plans.common import FRAMES, r, rounded
from brolga.sources.adapters import frames, phases, table


def frame_geometry(spark, d):
    rows = frames(spark, d)
    gaze = ("gaze_x", "gaze_y", "gaze_z")
    mismatch, silent = op.incongruence(F.col("is_audio_active") == 1, F.col("is_blinking") == 1, F.col("macro_motion_energy").isNotNull())
    return rounded(
        rows.select(
            "file_index",
            "idx",
            op.distance(gaze, ("AU12", "AU6", "AU4")).alias("distance"),
            op.speed(gaze).alias("speed"),
            op.onset("AU12").alias("onset"),
            op.joint_confidence(F.col("joint_confidence"), F.col("macro_motion_energy")).alias("confidence"),
            mismatch.alias("mismatch"),
            silent.alias("silent"),
        )
    )


GEOMETRY = f"""with {FRAMES}, s as (select *, gaze_x - lag(gaze_x) over w as dx, gaze_y - lag(gaze_y) over w as dy, gaze_z - lag(gaze_z) over w as dz,
  AU12 - lag(AU12) over w as da from frames window w as (partition by file_index order by t))
select file_index, idx, {r("sqrt((gaze_x-AU12)*(gaze_x-AU12)+(gaze_y-AU6)*(gaze_y-AU6)+(gaze_z-AU4)*(gaze_z-AU4))")} as distance, {r("sqrt(dx*dx+dy*dy+dz*dz)")} as speed,
  {r("coalesce(da, 0)")} as onset, {r("coalesce(w, 0) * coalesce(macro_motion_energy, 0)")} as confidence,
  case when macro_motion_energy is not null then case when is_audio_active = 1 and is_blinking <> 1 then 1e0 else 0e0 end end as mismatch,
  case when macro_motion_energy is not null then case when is_blinking = 1 and is_audio_active <> 1 then 1e0 else 0e0 end end as silent from s"""


def frame_fusion(spark, d):
    rows = frames(spark, d)
    left, right = rows.where("idx % 2 = 0").select("file_index", "timestamp", "AU12"), rows.where("idx % 3 = 0").select("file_index", "timestamp", "AU6")
    return rounded(op.fuse(left, right).groupBy("file_index").agg(F.count("*").alias("n"), F.sum("AU12").alias("a"), F.sum("AU6").alias("b")))


FUSION = f"""with {FRAMES} select file_index, count(*) as n, {r("sum(AU12)")} as a, {r("sum(AU6)")} as b from frames where idx % 6 = 0 group by file_index"""


def log_zip(spark, d):
    rows = frames(spark, d)
    right = rows.where("is_blinking = 0").select("file_index", "timestamp", F.col("AU6").alias("ear"))
    out = op.zip_by_position(rows.select("file_index", "timestamp", "idx"), right)
    return rounded(out.select("file_index", "idx", F.coalesce("ear", F.lit(0.0)).alias("ear")))


ZIP = f"""with {FRAMES}, a as (select file_index, idx, row_number() over (partition by file_index order by t) as i from frames),
b as (select file_index, AU6, row_number() over (partition by file_index order by t) as i from frames where is_blinking = 0)
select a.file_index, a.idx, {r("coalesce(b.AU6, 0)")} as ear from a left join b on a.file_index = b.file_index and a.i = b.i"""


def _segments(rows):
    return rows.select("file_index").distinct().select(
        "file_index", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")
    ).select("file_index", (F.col("n") * 4000 + F.col("file_index") % 7 * 100).alias("start_ms"), "n").select(
        "file_index", "start_ms", (F.col("start_ms") + 1500 + F.col("n") * 900).alias("end_ms"), F.concat(F.lit("s"), F.col("n") % 2).alias("speaker")
    )


SEGMENTS = """segs as (select file_index, n * 4000 + file_index % 7 * 100 as start_ms, n * 4000 + file_index % 7 * 100 + 1500 + n * 900 as end_ms, 's' || (n % 2) as speaker
  from (select distinct l_suppkey as file_index from lineitem), range(0, 5) as x(n))"""


def speech_active(spark, d):
    rows = frames(spark, d)
    return op.speech_flag(rows.select("file_index", "timestamp", "idx"), _segments(rows)).select("file_index", "idx", "in_speech")


SPEECH = f"""with {FRAMES}, {SEGMENTS} select f.file_index, f.idx, case when exists (select 1 from segs s where s.file_index = f.file_index and f.t >= s.start_ms and f.t < s.end_ms)
  then 1e0 else 0e0 end as in_speech from frames f"""


def speaker_anchor(spark, d):
    rows = frames(spark, d)
    moving = rows.select("file_index", "timestamp", F.col("is_blinking").alias("is_moving"), F.col("AU12").alias("velocity"))
    return rounded(op.anchor_speaker(moving, _segments(rows)))


ANCHOR = f"""with {FRAMES}, {SEGMENTS}, sc as (select f.file_index, s.speaker, avg(is_blinking) * avg(AU12) as score from frames f join segs s on s.file_index = f.file_index and f.t >= s.start_ms and f.t < s.end_ms group by 1, 2),
h as (select file_index, speaker, min(start_ms) as first from segs group by 1, 2)
select file_index, speaker, {r("score")} as score from (select sc.*, row_number() over (partition by sc.file_index order by score desc, first, speaker) as n from sc join h using (file_index, speaker)) where n = 1"""


def clip_normalise(spark, d):
    rows = frames(spark, d)
    return rounded(rows.select("file_index", "idx", op.normalise_clip("AU12").alias("z"), op.silence_mask(F.col("AU6"), F.lit(1), F.col("joint_confidence"), F.col("is_audio_active")).alias("masked")))


NORMALISE = f"""with {FRAMES} select file_index, idx, {r("(AU12 - avg(AU12) over c) / sqrt(var_pop(AU12) over c + 1e-7)")} as z,
  {r("case when w >= 0.005 and is_audio_active = 1 then AU6 end")} as masked from frames window c as (partition by file_index)"""


def row_blocks(spark, d):
    return rounded(op.block_windows(frames(spark, d)))


BLOCKS = f"""with {FRAMES}, b as (select *, (row_number() over (partition by file_index order by t) - 1) // 60 as window_id from frames),
m as (select file_index, window_id, emotion_label, row_number() over (partition by file_index, window_id order by count(*) desc, emotion_label) as n from b group by 1, 2, 3)
select b.file_index, b.window_id, count(*) as n, {", ".join(f"{r(f'{f}({c})')} as {c}_{n}" for c in ("AU12", "gaze_x") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")))},
  any_value(m.emotion_label) as emotion_mode from b join m on m.file_index = b.file_index and m.window_id = b.window_id and m.n = 1 group by 1, 2 having count(*) = 60"""


def latent_pooling(spark, d):
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") * 20.0).alias("center_ms"), F.col("embedding").alias("latent"))
    out = op.pool_latents(rows, ["label"], 1000.0)
    return rounded(out.select("label", "k", F.col("n").cast("long").alias("n"), F.col("mean")[0].alias("first"), F.col("mean")[63].alias("last")))


POOLING = f"""select label, floor(vec_id * 20e0 / 1000)::bigint as k, count(*) as n, {r("avg(embedding[1]::double)")} as first, {r("avg(embedding[64]::double)")} as last from embeddings group by 1, 2"""


def latent_steps(spark, d):
    rows = op.cosine_velocity(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    return rounded(rows.select("vec_id", "step", op.group_means(F.col("embedding"), 64, 16)[3].alias("group_3")))


STEPS = f"""with e as (select *, lag(embedding) over (partition by label order by vec_id) as p from embeddings)
select vec_id, {r("case when p is not null then 1 - list_cosine_similarity(embedding::double[], p::double[]) end")} as step,
  {r("(embedding[13]::double + embedding[14]::double + embedding[15]::double + embedding[16]::double) / 4")} as group_3 from e"""


def interval_rms(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("sample_idx"), F.col("value").alias("x"))
    return rounded(op.interval_rms(rows, ["user_id"], 1000.0, 500.0))


RMS = f"""select user_id, floor(event_id / 500e0)::bigint as k, {r("sqrt(avg(value * value))")} as rms from events group by 1, 2"""


def phase_as_of(spark, d):
    spans = phases(spark, d)
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    points = table(spark, d, "events").where("event_type <> 'signup'").select((F.col("user_id") % 10).alias("grp"), "event_id", ts.alias("t"))
    return rounded(as_of(points, spans.select("grp", "start_ms", "end_ms", "phase"), ["grp"], "t", ["phase"]).select("grp", "event_id", "phase", "elapsed_ms"), 2)


AS_OF = f"""with p as (select user_id % 10 as grp, epoch_us(ts) / 1000e0 as start_ms, epoch_us(ts) / 1000e0 + (coalesce(cast(props ->> '$.k' as bigint), 0) + 1) * 3600000e0 as end_ms, 'p' || (event_id % 7) as phase from events where event_type = 'signup'),
q as (select user_id % 10 as grp, event_id, epoch_us(ts) / 1000e0 as t from events where event_type <> 'signup')
select q.grp, event_id, case when t < end_ms then phase end as phase, {r("case when t < end_ms then t - start_ms end", 2)} as elapsed_ms from q asof left join p on q.grp = p.grp and q.t >= p.start_ms"""


def gaze_cells(spark, d):
    rows = frames(spark, d).where("macro_motion_energy is not null").groupBy("file_index", F.floor(F.col("gaze_x") * 10).alias("cell")).agg(F.count("*").alias("n"))
    return rounded(rows.groupBy("file_index").agg(entropy(F.col("n")).alias("entropy"), F.count("*").alias("cells")))


CELLS = f"""with {FRAMES}, c as (select file_index, floor(gaze_x * 10) as cell, count(*) as n from frames where macro_motion_energy is not null group by 1, 2),
s as (select *, sum(n) over (partition by file_index) as total from c) select file_index, {r("sum(-(n / total) * log2(n / total))")} as entropy, count(*) as cells from s group by 1"""


def offset_clock(spark, d):
    """Durations of clips, laid one behind the other."""
    last = frames(spark, d).groupBy("recording_id", "file_index").agg(F.max("idx").alias("duration_ms"))
    before = W.partitionBy("recording_id").orderBy("file_index").rowsBetween(W.unboundedPreceding, -1)
    return last.select("recording_id", "file_index", "duration_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)).alias("file_offset_ms"))


OFFSETS = f"""with {FRAMES}, l as (select recording_id, file_index, max(idx) as duration_ms from frames group by 1, 2)
select *, cast(coalesce(sum(duration_ms) over (partition by recording_id order by file_index rows between unbounded preceding and 1 preceding), 0) as bigint) as file_offset_ms from l"""

ALL = {
    "frame_geometry": (frame_geometry, GEOMETRY),
    "frame_fusion": (frame_fusion, FUSION),
    "log_zip": (log_zip, ZIP),
    "speech_active": (speech_active, SPEECH),
    "speaker_anchor": (speaker_anchor, ANCHOR),
    "clip_normalise": (clip_normalise, NORMALISE),
    "row_blocks": (row_blocks, BLOCKS),
    "latent_pooling": (latent_pooling, POOLING),
    "latent_steps": (latent_steps, STEPS),
    "interval_rms": (interval_rms, RMS),
    "phase_as_of": (phase_as_of, AS_OF),
    "gaze_cells": (gaze_cells, CELLS),
    "offset_clock": (offset_clock, OFFSETS),
}

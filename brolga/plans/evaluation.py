"""Queries on labelled windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.operators import evaluate as op
from brolga.plans.common import INTERVALS, SCORED, r, rounded
from brolga.sources.adapters import CHANNELS, intervals, long_form, regions, scored_windows, table

IDS = ["subject", "clip", "window_id", "label"]


def _long(spark, d):
    return long_form(scored_windows(spark, d), IDS)


def channel_auc(spark, d):
    rows = _long(spark, d)
    return rounded(op.rank_auc(rows, ["subject", "channel"], op.is_label("positive"), op.is_label("negative")))


def _auc_sql(rows, by, value="value", pos="label = 'positive'", neg="label = 'negative'"):
    return f"""(select {by}, n_pos, n_neg, case when n_pos >= 3 and n_neg >= 3 then (s - n_pos * (n_pos + 1) / 2e0) / (n_pos * n_neg) end as auc from (
      select {by}, count(case when {pos} then 1 end) as n_pos, count(case when {neg} then 1 end) as n_neg, sum(case when {pos} then rk end) as s from (
        select *, rank() over (partition by {by} order by {value}) + (count(*) over (partition by {by}, {value}) - 1) / 2e0 as rk from {rows} where {value} is not null and ({pos} or {neg})) group by {by}))"""


AUC = f"""with {SCORED} select subject, channel, n_pos, n_neg, {r("auc")} as auc from {_auc_sql("long", "subject, channel")}"""


def clip_auc(spark, d):
    rows = _long(spark, d)
    return rounded(op.rank_auc(rows, ["clip", "channel"], op.is_label("positive"), op.is_label("neutral")))


CLIP_AUC = f"""with {SCORED} select clip, channel, n_pos, n_neg, {r("auc")} as auc from {_auc_sql("long", "clip, channel", neg="label = 'neutral'")}"""


def class_contrasts(spark, d):
    rows = _long(spark, d)
    m = lambda f, x: f(F.when(op.is_label(x), F.col("value")))
    out = rows.groupBy("subject", "channel").agg(*[m(f, x).alias(f"{n}_{x}") for x in ("positive", "negative", "neutral") for n, f in (("med", F.median), ("avg", F.avg))])
    rest = op.rank_auc(rows, ["subject", "channel"], op.is_label("positive"), ~op.is_label("positive")).select("subject", "channel", F.col("auc").alias("auc_rest"))
    return rounded(out.join(rest, ["subject", "channel"]))


_CONTRAST = ", ".join(f"{r(f + '(case when label = ' + chr(39) + x + chr(39) + ' then value end)')} as {n}_{x}" for x in ("positive", "negative", "neutral") for n, f in (("med", "median"), ("avg", "avg")))
CONTRASTS = f"""with {SCORED}, c as (select subject, channel, {_CONTRAST} from long group by 1, 2)
select c.*, {r("auc")} as auc_rest from c join {_auc_sql("long", "subject, channel", neg="label <> 'positive'")} a using (subject, channel)"""

PCT = f"""{SCORED}, pc as (select *, (rank() over (partition by subject, clip, channel, value is null order by abs(value)) + (count(*) over (partition by subject, clip, channel, abs(value)) - 1) / 2e0)
  / count(value) over (partition by subject, clip, channel) as p0, value - median(value) over (partition by subject, clip, channel) as centred from long),
pct as (select *, case when value is not null then p0 end as pct from pc)"""


def within_clip(spark, d):
    rows = op.centred(op.within_clip_percentile(_long(spark, d)))
    return rounded(rows.select("clip", "window_id", "channel", "pct", "centred"))


WITHIN = f"""with {PCT} select clip, window_id, channel, {r("pct")} as pct, {r("centred")} as centred from pct"""


def _scores(spark, d):
    return op.subject_scores(_long(spark, d))


def subject_scores(spark, d):
    return rounded(_scores(spark, d))


SCORES = f"""{PCT}, way as (select subject, channel, median(case when label = 'positive' then centred end) - median(case when label = 'negative' then centred end) as d from pct group by 1, 2),
scores as (select a.subject, a.channel, n_pos, n_neg, auc, cast(case when abs(d) >= 0.25 then sign(d) else 0 end as integer) as dir from {_auc_sql("pct", "subject, channel", "pct")} a join way w on a.subject = w.subject and a.channel = w.channel)"""
SUBJECT_SCORES = f"""with {SCORES} select subject, channel, n_pos, n_neg, {r("auc")} as auc, dir from scores"""


def replication_verdict(spark, d):
    return op.verdicts(_scores(spark, d))


VERDICT = f"""{SCORES}, ad as (select *, n_pos >= 30 and n_neg >= 30 and auc is not null as ok from scores),
vd as (select channel, count(case when ok then 1 end) as n_adequate, count(case when ok and auc >= 0.6 then 1 end) as high, count(case when ok and dir > 0 then 1 end) as up, count(case when ok and dir < 0 then 1 end) as down from ad group by 1),
verdicts as (select *, case when n_adequate < 2 then 'INSUFFICIENT-DATA' when up + down >= ceil(n_adequate * 2 / 3e0) and (up = 0 or down = 0) then case when high >= ceil(n_adequate * 2 / 3e0) then 'REPLICATES' else 'DIRECTION-ONLY' end
  when high > 0 then 'SUBJECT-SPECIFIC' else 'NO-SIGNAL' end as verdict from vd)"""
REPLICATION = f"with {VERDICT} select * from verdicts"


#: The channels that were to be followed: one that scores and one that does not.
TRACKED = ["tax", "discount"]


def replication_scorecard(spark, d):
    return rounded(op.scorecard(_scores(spark, d), list(range(6)), TRACKED))


SCORECARD = f"""with {VERDICT}, placed as (select *, channel in ('tax', 'discount') as tracked, row_number() over (order by channel in ('tax', 'discount') desc, verdict, channel) as place from verdicts) select v.*, {", ".join(f"{r(f'max(case when subject = {k} then auc end)')} as auc_{k}, max(case when subject = {k} then dir end) as dir_{k}" for k in range(6))}
  from placed v join scores s on s.channel = v.channel group by all"""


def every_second_auc(spark, d):
    rows = op.every_second(_long(spark, d))
    return rounded(op.rank_auc(rows, ["subject", "channel"], op.is_label("positive"), op.is_label("negative")))


SECOND = f"""with {SCORED}, half as (select * from long where window_id % 2 = 0) select subject, channel, n_pos, n_neg, {r("auc")} as auc from {_auc_sql("half", "subject, channel")}"""


def norm_domination(spark, d):
    return rounded(op.domination(op.centred(_long(spark, d)).withColumn("value", F.col("centred")), 2))


DOMINATION = f"""with {PCT}, sq as (select *, centred * centred as s, row_number() over (partition by subject, clip, window_id order by centred * centred desc, channel) as n from pct where centred is not null),
b as (select subject, clip, window_id, max(s) / nullif(sum(s), 0) as one, sum(case when n <= 2 then s end) / nullif(sum(s), 0) as top from sq group by 1, 2, 3)
select subject, {r("median(one)")} as median_one, {r("quantile_cont(one, 0.9)")} as p90_one, {r("median(top)")} as median_some from b group by 1"""


def norm_alternatives(spark, d):
    return rounded(op.alternative_norms(op.centred(_long(spark, d)).withColumn("value", F.col("centred")), 1))


ALTERNATIVES = f"""with {PCT}, z as (select *, abs(centred) as a, row_number() over (partition by subject, clip, window_id order by abs(centred) desc, channel) as n from pct where centred is not null)
select subject, clip, window_id, label, {r("sqrt(sum(a * a))")} as l2, {r("median(a)")} as median, {r("sqrt(coalesce(sum(case when n > 1 then a * a end), 0))")} as l2_rest, count(case when a > 3 then 1 end) as over_3 from z group by 1, 2, 3, 4"""


def _errors(spark, d):
    rows = op.centred(_long(spark, d))
    auc = op.rank_auc(rows, ["subject", "channel"], op.is_label("positive"), op.is_label("negative"), "centred")
    return auc.withColumn("se", op.auc_error(F.col("auc"), F.col("n_pos"), F.col("n_neg")))


def random_effects(spark, d):
    return rounded(op.random_effects(_errors(spark, d)))


_ERR = f"""{PCT}, er as (select *, sqrt(greatest(1e-9, (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg))) as se
  from {_auc_sql("pct", "subject, channel", "centred")} where auc is not null)"""
_POOL = f"""{_ERR}, fx as (select channel, count(*) as k, sum(auc / (se * se)) / sum(1 / (se * se)) as f, sum(1 / (se * se)) as sw, sum(1 / (se * se * se * se)) as sw2 from er group by 1),
qq as (select er.channel, k, sw, sw2, sum((auc - f) * (auc - f) / (se * se)) as q from er join fx using (channel) group by all),
ht as (select channel, k, q, case when sw - sw2 / sw > 0 then greatest(0e0, (q - (k - 1)) / (sw - sw2 / sw)) else 0 end as tau2, case when q > 0 then greatest(0e0, (q - (k - 1)) / q) else 0 end as i2 from qq),
pooled as (select channel, k, q, tau2, i2, sum(auc / (se * se + tau2)) / sum(1 / (se * se + tau2)) as pooled, 1 / sqrt(sum(1 / (se * se + tau2))) as se from er join ht using (channel) group by channel, k, q, tau2, i2)"""
EFFECTS = f"""with {_POOL} select channel, k, {r("q")} as q, {r("tau2")} as tau2, {r("i2")} as i2, {r("pooled")} as pooled, {r("se")} as se from pooled"""


def meta_candidates(spark, d):
    e = _errors(spark, d)
    pooled = op.random_effects(e)
    side = e.where("auc is not null").join(pooled.select("channel", "pooled"), "channel")
    same = side.groupBy("channel").agg(F.avg((F.signum(F.col("auc") - 0.5) == F.signum(F.col("pooled") - 0.5)).cast("double")).alias("consistency"))
    rows = pooled.join(same, "channel")
    return rounded(rows.select("channel", "consistency", (F.col("pooled") - 1.96 * F.col("se")).alias("low"), (F.col("pooled") + 1.96 * F.col("se")).alias("high")))


CANDIDATES = f"""with {_POOL}, cs as (select er.channel, avg(case when sign(auc - 0.5) = sign(pooled - 0.5) then 1e0 else 0e0 end) as consistency from er join pooled using (channel) group by 1)
select channel, {r("consistency")} as consistency, {r("pooled - 1.96 * se")} as low, {r("pooled + 1.96 * se")} as high from pooled join cs using (channel)"""


def answer_segments(spark, d):
    rows = op.answer_segments(scored_windows(spark, d))
    return rounded(rows.groupBy("subject", "clip", "seg", "label").agg(F.count("*").alias("n"), F.avg("quantity").alias("score")))


SEGMENTS = f"""with {SCORED}, c as (select *, case when label is distinct from lag(label) over (partition by clip order by window_id) then 1 else 0 end as ch from scored),
g as (select *, cast(sum(ch) over (partition by clip order by window_id) as bigint) as seg from c) select subject, clip, seg, label, count(*) as n, {r("avg(quantity)")} as score from g group by 1, 2, 3, 4"""


def segment_auc(spark, d):
    seg = op.answer_segments(scored_windows(spark, d)).groupBy("subject", "clip", "seg", "label").agg(F.avg("quantity").alias("value"))
    return rounded(op.rank_auc(seg, ["subject"], op.is_label("positive"), op.is_label("negative")))


SEGMENT_AUC = f"""with {SCORED}, c as (select *, case when label is distinct from lag(label) over (partition by clip order by window_id) then 1 else 0 end as ch from scored),
g as (select *, sum(ch) over (partition by clip order by window_id) as seg from c), v as (select subject, clip, seg, label, avg(quantity) as value from g group by 1, 2, 3, 4)
select subject, n_pos, n_neg, {r("auc")} as auc from {_auc_sql("v", "subject")}"""


def strongest_channel(spark, d):
    return rounded(op.strongest_channel(_long(spark, d)))


STRONGEST = f"""with {SCORED}, p as (select *, (rank() over (partition by subject, channel, value is null order by abs(value)) + (count(*) over (partition by subject, channel, abs(value)) - 1) / 2e0) / count(value) over (partition by subject, channel) as p0 from long),
q as (select * from p where value is not null), a as (select * from {_auc_sql("q", "subject, channel", "p0")})
select subject, channel, n_pos, n_neg, {r("auc")} as auc from (select *, row_number() over (partition by subject order by auc desc nulls last, channel) as n from a) where n = 1"""


def focus_clip(spark, d):
    return op.focus_clip(scored_windows(spark, d))


FOCUS = f"""with {SCORED}, n as (select subject, clip, count(case when label = 'positive' then 1 end) as n_pos, count(case when label = 'negative' then 1 end) as n_neg from scored group by 1, 2)
select subject, clip, n_pos, n_neg from (select *, row_number() over (partition by subject order by least(n_pos, n_neg) desc, clip) as k from n where least(n_pos, n_neg) >= 20) where k = 1"""


def stability_gate(spark, d):
    return rounded(op.stability(scored_windows(spark, d), "quantity", F.col("clip") % 5 == 0))


STABILITY = f"""with {SCORED}, b as (select subject, quantile_cont(quantity, 0.95) as p95, median(quantity) as base from scored where clip % 5 = 0 group by 1),
v as (select *, case when quantity > p95 then 1e0 else 0e0 end as over from scored join b using (subject)),
o as (select subject, base, median(case when label = 'positive' then quantity end) as med_pos, median(case when label = 'negative' then quantity end) as med_neg,
  avg(case when clip % 5 = 0 then over end) as flag_base, avg(case when label = 'positive' then over end) as flag_pos, avg(case when label = 'negative' then over end) as flag_neg from v group by 1, 2)
select subject, {r("base")} as base, {r("med_pos")} as med_pos, {r("med_neg")} as med_neg, {r("flag_base")} as flag_base, {r("flag_pos")} as flag_pos, {r("flag_neg")} as flag_neg,
  abs(med_neg - base) <= greatest(1, 0.5 * abs(med_pos - base)) and flag_neg <= flag_base + 0.15 as stable from o"""


def label_overlap(spark, d):
    windows = intervals(spark, d).select("file_index", F.col("turn").alias("window_id"), "start_ms", "end_ms")
    spans = regions(spark, d)
    n = F.row_number().over(W.partitionBy("file_index").orderBy("start_ms"))
    labels = spans.select("file_index", "start_ms", "end_ms", F.concat(F.lit("r"), F.floor(F.col("start_ms") / 1000) % 3).alias("label"), n.alias("ordinal"))
    return rounded(op.label_windows(windows, labels, ["file_index"]))


OVERLAP = f"""with {INTERVALS}, g as (select file_index, start_ms + 500 as s, end_ms + 500 as e from intervals where turn % 3 = 0),
lb as (select *, 'r' || (s // 1000 % 3) as label, row_number() over (partition by file_index order by s) as o from g),
m as (select i.file_index, i.turn, lb.label, least(i.end_ms, e) - greatest(i.start_ms, s) as ov, row_number() over (partition by i.file_index, i.turn order by least(i.end_ms, e) - greatest(i.start_ms, s) desc, o) as n
  from intervals i join lb on lb.file_index = i.file_index and i.start_ms < e and s < i.end_ms)
select i.file_index, i.turn as window_id, i.start_ms, i.end_ms, coalesce(m.label, 'Unlabeled') as label, {r("coalesce(ov / greatest(1, i.end_ms - i.start_ms), 0)")} as fraction
from intervals i left join m on m.file_index = i.file_index and m.turn = i.turn and n = 1"""


def label_spelling(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), F.upper("role"), F.lit(" ")).alias("x"))
    return rows.select("conv_id", "turn", op.normal_label(F.col("x"), {"user": "Truth", "assistant": "Lie"}).alias("label"))


SPELLING = """select conv_id, turn, case lower(role) when 'user' then 'Truth' when 'assistant' then 'Lie' else upper(role) end as label from conversations"""


def _package(spark, d):
    """Clips, labels and probed media of the subjects: some clips without a number, one twice, labels that are thin or odd."""
    w = scored_windows(spark, d)
    first = F.min("clip").over(W.partitionBy("subject"))
    clips = w.select("subject", "clip").distinct().select("subject", F.when(F.col("clip") % 11 != 0, F.col("clip")).alias("clip"), (F.col("clip") == first).alias("baseline"))
    clips = clips.union(clips.where("subject = 3 and clip % 13 = 0"))
    start = F.col("window_id") * 1000
    length = F.when((F.col("subject") == 2) & (F.col("window_id") == 7), 0).otherwise(F.col("quantity") * 20)
    odd = F.when((F.col("subject") == 1) & (F.col("discount") == 0), "other").otherwise(F.col("label"))
    labels = w.where("clip % 7 <> 3").select("subject", "clip", start.alias("start_ms"), (start + length).alias("end_ms"), odd.alias("label"))
    media = w.groupBy("subject", "clip").agg((F.count("*") / 3).alias("duration_s")).withColumns({"has_video": F.lit(True), "has_audio": (F.col("subject") != 4) | (F.col("clip") % 17 != 5)})
    return clips, labels, media


def package_checks(spark, d):
    return op.package_checks(*_package(spark, d))


def readiness_gate(spark, d):
    checks = op.package_checks(*_package(spark, d)).select("subject", F.when(F.col("subject") != 5, F.col("overall")).alias("overall"))
    return op.readiness(checks.withColumns({"recorded": F.col("subject") != 0, "labelled": F.lit(True)}))


_CHECKED = f"""{SCORED}, c0 as (select distinct subject, clip from scored), c1 as (select subject, case when clip % 11 <> 0 then clip end as clip, clip = min(clip) over (partition by subject) as baseline from c0),
clips as (select * from c1 union all select * from c1 where subject = 3 and clip % 13 = 0),
nu as (select subject, clip, count(*) as n, max(baseline::int) as base from clips where clip is not null group by 1, 2),
lab as (select subject, clip, window_id * 1000 as s, window_id * 1000 + case when subject = 2 and window_id = 7 then 0 else quantity * 20 end as e, case when subject = 1 and discount = 0 then 'other' else label end as label from scored where clip % 7 <> 3),
lo as (select subject, clip, sum(greatest(0, e - s)) as ms, max((e <= s)::int) as bad, max((label not in ('positive', 'negative', 'neutral'))::int) as odd from lab group by 1, 2),
me as (select coalesce(nu.subject, lo.subject) as subject, base, n, ms, bad, odd from nu full join lo on nu.subject = lo.subject and nu.clip = lo.clip),
c as (select subject, count(*) as clips, count(case when baseline then 1 end) as bases, count(*) - count(clip) as loose from clips group by 1), sm as (select subject, max(n) as same from nu group by 1),
e as (select subject, count(ms) as labelled, count(case when base = 0 and ms is null then 1 end) as unlabelled, count(case when n is null then 1 end) as orphans, max(bad) as bad, max(odd) as odd, min(ms) as least from me group by 1),
md as (select subject, clip, count(*) / 3e0 as dur, not (subject = 4 and clip % 17 = 5) as ok from scored group by 1, 2),
m as (select md.subject, max((not ok)::int) as broken, max(case when base = 1 then dur end) as base_s from md left join nu on nu.subject = md.subject and nu.clip = md.clip group by 1),
k as (select c.subject, case when clips < 2 then 'FAIL' else 'PASS' end as v1, case when bases <> 1 then 'FAIL' when loose > 0 then 'WARN' else 'PASS' end as v2, case when same > 1 then 'FAIL' else 'PASS' end as v3,
  case when coalesce(labelled, 0) = 0 then 'WARN' when unlabelled > 0 then 'FAIL' when orphans > 0 then 'WARN' else 'PASS' end as e1,
  case when coalesce(labelled, 0) = 0 then 'SKIP' when bad = 1 then 'FAIL' else 'PASS' end as e2, case when coalesce(labelled, 0) = 0 then 'SKIP' when odd = 1 then 'WARN' else 'PASS' end as e3,
  case when coalesce(labelled, 0) = 0 then 'SKIP' when least < 10000 then 'WARN' else 'PASS' end as e4, case when broken is null then 'SKIP' when broken = 1 then 'FAIL' else 'PASS' end as m1,
  case when broken is null or bases <> 1 then 'SKIP' when base_s is null then 'WARN' when base_s < 60 then 'FAIL' when base_s < 120 then 'WARN' else 'PASS' end as m2
  from c left join sm using (subject) left join e using (subject) left join m using (subject)),
checked as (select *, case when 'FAIL' in (v1, v2, v3, e1, e2, e3, e4, m1, m2) then 'FAIL' when 'WARN' in (v1, v2, v3, e1, e2, e3, e4, m1, m2) then 'WARN' else 'PASS' end as overall from k)"""
PACKAGE = f"with {_CHECKED} select * from checked"
READY = f"""with {_CHECKED}, r as (select subject, case when subject <> 5 then overall end as overall, case when subject <> 0 then 'READY' else 'PENDING' end as state from checked),
g as (select count(case when overall = 'FAIL' then 1 end) = 0 and count(case when state = 'READY' then 1 end) >= 2 as go from r)
select subject, coalesce(overall, 'SKIPPED') as intake, state, go from r, g"""


def run_comparison(spark, d):
    s = _scores(spark, d)
    half = op.subject_scores(op.every_second(_long(spark, d)))
    return rounded(op.compare_runs(s.select("subject", "channel", "auc"), half))


_HALF_PCT = PCT[PCT.index("pc as"):].replace("pc as", "hpc as").replace("from long)", "from hlong)").replace("pct as (select *, case when value is not null then p0 end as pct from pc)", "hpct as (select *, case when value is not null then p0 end as pct from hpc)")
COMPARISON = f"""with {PCT}, hlong as (select * from long where window_id % 2 = 0), {_HALF_PCT},
now as (select * from {_auc_sql("pct", "subject, channel", "pct")}), before as (select * from {_auc_sql("hpct", "subject, channel", "pct")})
select now.subject, now.channel, {r("now.auc")} as auc, {r("before.auc")} as auc_before, {r("now.auc - before.auc")} as change from now left join before on before.subject = now.subject and before.channel = now.channel"""


def loso_auc(spark, d):
    """Held-out AUC of the leave-one-subject-out model."""
    rows = scored_windows(spark, d)
    clip = W.partitionBy("subject", "clip")
    rows = rows.withColumns({c: (F.col(c) - F.median(c).over(clip)).cast("double") for c in CHANNELS})
    said = op.loso(rows, list(CHANNELS)).withColumn("value", F.col("score"))
    return rounded(op.rank_auc(said, ["subject"], op.is_label("positive"), op.is_label("negative")), 3)


ALL = {
    "channel_auc": (channel_auc, AUC),
    "clip_auc": (clip_auc, CLIP_AUC),
    "class_contrasts": (class_contrasts, CONTRASTS),
    "within_clip": (within_clip, WITHIN),
    "subject_scores": (subject_scores, SUBJECT_SCORES),
    "replication_verdict": (replication_verdict, REPLICATION),
    "replication_scorecard": (replication_scorecard, SCORECARD),
    "every_second_auc": (every_second_auc, SECOND),
    "norm_domination": (norm_domination, DOMINATION),
    "norm_alternatives": (norm_alternatives, ALTERNATIVES),
    "random_effects": (random_effects, EFFECTS),
    "meta_candidates": (meta_candidates, CANDIDATES),
    "answer_segments": (answer_segments, SEGMENTS),
    "segment_auc": (segment_auc, SEGMENT_AUC),
    "strongest_channel": (strongest_channel, STRONGEST),
    "focus_clip": (focus_clip, FOCUS),
    "stability_gate": (stability_gate, STABILITY),
    "label_overlap": (label_overlap, OVERLAP),
    "label_spelling": (label_spelling, SPELLING),
    "package_checks": (package_checks, PACKAGE),
    "readiness_gate": (readiness_gate, READY),
    "run_comparison": (run_comparison, COMPARISON),
    "loso_auc": (loso_auc, None),
}

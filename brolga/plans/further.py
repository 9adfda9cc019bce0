"""Queries on guards, rankings, graph losses, faces, consensus anchors, logs and the whole window table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import cosine, nearest
from brolga.operators import audit, calibrate, diarize, enroll, evaluate, graph, pools, report, windows
from brolga.plans.common import FRAMES, INTERVALS, SCORED, r, rounded
from brolga.plans.diarization import _NODES, _OK, nodes, _durations, _tiers
from brolga.plans.diarization import DUR, TIERS
from brolga.plans.enrolment import _LIKE_SEED, sessions
from brolga.plans.evaluation import CHANNELS, OVERLAP, PCT, _auc_sql, _long, _scores, label_overlap
from brolga.plans.more import _COS, SPECTRUM, _cosines
from brolga.plans.windows import _INDEX, _INDEX_SQL, _STILL, ENTROPY, WIDE, WINDOWS, windows_sql
from brolga.sources.adapters import frames, intervals, pool, regions, scored_windows, table


def midpoint_labels(spark, d):
    """Windows around turns; phases reach over the next ones, so that several hold a middle and the latest of them may have ended."""
    w = intervals(spark, d).select("file_index", F.col("turn").alias("window_id"), F.col("start_ms").alias("start_time_ms"), F.col("end_ms").alias("end_time_ms"))
    late = F.when(F.col("start_ms") % 2000 < 1000, 9000).otherwise(0)
    phases = regions(spark, d).unionByName(intervals(spark, d).where("turn % 2 = 0").select("file_index", (F.col("start_ms") - 300).alias("start_ms"), F.least("end_ms", F.col("start_ms") + 900).alias("end_ms")))
    phases = phases.select("file_index", "start_ms", (F.col("end_ms") + late).alias("end_ms"), F.concat(F.lit("q"), F.pmod(F.floor(F.col("start_ms") / 100), F.lit(7))).alias("label"))
    return calibrate.label_midpoints(w, phases, ["file_index"]).select("file_index", "window_id", "target_ground_truth")


MIDPOINTS = f"""with {INTERVALS}, p as (select file_index, start_ms + 500 as s, end_ms + 500 as e from intervals where turn % 3 = 0 union all select file_index, start_ms - 300, least(end_ms, start_ms + 900) from intervals where turn % 2 = 0),
g as (select file_index, s, e + case when s % 2000 < 1000 and s % 2000 >= 0 then 9000 when s % 2000 < 0 then 9000 else 0 end as e, 'q' || (floor(s / 100e0)::bigint - 7 * floor(floor(s / 100e0) / 7e0)::bigint) as label from p),
m as (select i.file_index, turn, (i.start_ms + i.end_ms) / 2e0 as t, max((g.s, g.e, g.label)) as x from intervals i join g on g.file_index = i.file_index and g.s <= (i.start_ms + i.end_ms) / 2e0 group by 1, 2, 3)
select i.file_index, i.turn as window_id, case when m.t < x[2] then x[3] else 'unlabeled' end as target_ground_truth from intervals i left join m on m.file_index = i.file_index and m.turn = i.turn"""


def _muted(spark, d):
    """Frames, those of every ninth clip without any confidence."""
    return frames(spark, d).withColumn("joint_confidence", F.when(F.col("file_index") % 9 == 4, 0.0).otherwise(F.col("joint_confidence")))


def usable_clips(spark, d):
    rows = calibrate.usable_clips(windows.window_table(_muted(spark, d)))
    return rows.groupBy("recording_id", "file_index").agg(F.count("*").alias("windows"))


USABLE = f"""with {WINDOWS} select recording_id, file_index, count(*) as windows from windows where file_index % 9 <> 4 group by 1, 2 having count(active_ratio) > 0"""


def guarded_recordings(spark, d):
    """The guarded job on the muted frames: by recording what is left, and its first clip."""
    rows = calibrate.recording_job(_muted(spark, d), guard=True)
    return rows.groupBy("recording_id").agg(F.countDistinct("file_index").alias("clips"), F.count("*").alias("windows"), F.min("file_index").alias("baseline"))


GUARDED = f"""with {WINDOWS}, u as (select recording_id, file_index, count(*) as n from windows where file_index % 9 <> 4 group by 1, 2 having count(active_ratio) > 0)
select recording_id, count(*) as clips, cast(sum(n) as bigint) as windows, min(file_index) as baseline from u group by 1"""


def channel_ranking(spark, d):
    return rounded(evaluate.channel_ranking(_long(spark, d), best=2, worst=1))


RANKING = f"""with {SCORED}, sized as (select *, abs(value) as size, 1 as one from long), a as (select * from {_auc_sql("sized", "channel", "size")} where auc is not null),
m as (select channel, median(case when label = 'positive' then size end) as med_positive, median(case when label = 'negative' then size end) as med_negative from sized group by 1),
p as (select a.*, med_positive, med_negative, row_number() over (order by auc desc, channel) as place, count(*) over () as n from a join m using (channel))
select channel, n_pos, n_neg, {r("auc")} as auc, {r("med_positive")} as med_positive, {r("med_negative")} as med_negative, place from p where place <= 2 or place > n - 1"""


def coupling_bars(spark, d):
    return rounded(evaluate.coupling_bars(_scores(spark, d), ["price", "tax"], "discount"))


BARS = f"""with {PCT}, a as (select * from {_auc_sql("pct", "subject, channel", "pct")}), o as (select *, row_number() over (partition by subject order by coalesce(auc, 0) desc, channel) as n from a),
b as (select subject, max(auc) as best, max(case when channel = 'discount' then auc end) as eye, max(case when n <= 3 and channel in ('price', 'tax') then 1 else 0 end) as told from o group by 1)
select subject, {r("best")} as best, {r("eye")} as eye, case when best >= 0.69 then 'PASS' when best >= 0.66 then 'MISS' else 'FAIL' end as bar_1, case when told = 1 then 'PASS' else 'FAIL' end as bar_2,
  case when eye >= 0.55 then 'PASS' else 'FAIL' end as bar_3 from b"""


def _centred(spark, d):
    clip = W.partitionBy("subject", "clip")
    return scored_windows(spark, d).withColumns({c: (F.col(c) - F.median(c).over(clip)).cast("double") for c in CHANNELS})


def loso_flags(spark, d):
    """Held-out AUC and share of flagged negatives of a panel of two channels."""
    said = evaluate.loso(_centred(spark, d), ["quantity", "discount"], least=15)
    auc = evaluate.rank_auc(said.withColumn("value", F.col("score")), ["subject"], evaluate.is_label("positive"), evaluate.is_label("negative")).select("subject", "auc")
    return rounded(evaluate.flag_rate(said).join(auc, "subject"), 3)


def loso_weights(spark, d):
    return rounded(evaluate.loso_coefficients(_centred(spark, d), list(CHANNELS), least=15), 3)


def pure_windows(spark, d):
    return evaluate.pure(label_overlap(spark, d))


PURE = f"select * from ({OVERLAP}) where fraction >= 0.6"


def loso_verdict(spark, d):
    """The verdict on AUCs by subject, here those of the price."""
    return rounded(evaluate.loso_summary(_scores(spark, d).where("channel = 'price'").select("subject", "auc")))


VERDICT = f"""with {PCT}, a as (select * from {_auc_sql("pct", "subject, channel", "pct")} where channel = 'price'),
s as (select avg(auc) as mean, stddev_samp(auc) as sd, count(case when auc >= 0.58 then 1 end) as clear, count(auc) as n from a)
select {r("mean")} as mean, {r("sd")} as sd, clear, n, case when mean is null then 'INSUFFICIENT' when mean >= 0.62 and clear >= 4 then 'GENERALIZES' when mean >= 0.55 then 'WEAK/PARTIAL' else 'SUBJECT-SPECIFIC' end as verdict from s"""

_ZS = f"""{FRAMES}, l as ({_NODES}), st as (select recording_id, channel, coalesce(avg(v), 0) as m, case when coalesce(stddev_samp(v), 0) < 1e-8 then 1e0 else stddev_samp(v) end as sd from l group by 1, 2),
zs as (select file_index, idx, channel, {_OK} as ok, case when {_OK} then (v - m) / sd else 0 end as z from l join st using (recording_id, channel))"""


def graph_losses(spark, d):
    """Weighted loss by clip of taking each frame's AU6 for its AU12, against that of predicting nothing, and their ratio; frames
    without a valid AU12 weigh nothing."""
    rows = frames(spark, d)
    z = nodes(rows)
    other = z.where("channel = 'AU6'").select("file_index", "idx", F.col("z").alias("predicted"))
    own = z.where("channel = 'AU12'")
    weight = rows.select("file_index", "idx", F.col("joint_confidence").alias("w"))
    loss = lambda x: graph.weighted_loss(graph.masked_error(x, ["file_index", "idx"]).join(weight, ["file_index", "idx"]), ["file_index"], "w", target=True)
    return rounded(graph.coupling_ratio(loss(own.join(other, ["file_index", "idx"])), loss(own.withColumn("predicted", F.lit(0.0))), ["file_index"]), 5)


LOSSES = f"""with {_ZS}, e as (select a.file_index, case when a.ok then w else 0 end as w, case when a.ok then (b.z - a.z) * (b.z - a.z) else 0 end as e, case when a.ok then a.z * a.z else 0 end as e0
  from zs a join zs b on b.file_index = a.file_index and b.idx = a.idx and b.channel = 'AU6' join frames f on f.file_index = a.file_index and f.idx = a.idx where a.channel = 'AU12'),
o as (select file_index, sum(e * w) / greatest(sum(w), 1e-6) as loss, sum(e0 * w) / greatest(sum(w), 1e-6) as zero_loss from e group by 1)
select file_index, {r("loss", 5)} as loss, {r("zero_loss", 5)} as zero_loss, {r("loss / nullif(zero_loss, 0)", 5)} as ratio, loss / nullif(zero_loss, 0) < 0.9 as healthy from o"""


def zero_reference(spark, d):
    z = nodes(frames(spark, d))
    return rounded(graph.zero_reference(z, graph.temporal_split(graph.model_windows(z, least=0.45))), 5)


ZERO = f"""with {_ZS}, n as (select file_index, max(idx) + 1 as n from frames group by 1), a as (select zs.*, n, unnest(range(greatest(0, floor((idx - 90) / 15e0) + 1)::bigint, idx // 15 + 1)) as w from zs join n using (file_index)),
g as (select file_index, w, sum(ok::int) as valid from a where w * 15 + 90 <= n group by 1, 2 having sum(ok::int) >= 0.45 * 90 * 4),
t as (select file_index, w, row_number() over (partition by file_index order by w) <= floor(count(*) over (partition by file_index) * 0.8e0) as train from g)
select a.file_index, {r("coalesce(sum(case when ok then z * z end), 0) / greatest(1e-6, count(case when ok then 1 end))", 5)} as loss from a join t on t.file_index = a.file_index and t.w = a.w and not train group by 1"""


def hop_errors(spark, d):
    """Errors of overlapping windows averaged by frame, then by hops: a window's error is its square times its place."""
    rows = frames(spark, d).select("file_index", "idx", (F.col("AU12") * F.col("AU12")).alias("sq"), F.col("is_audio_active").cast("int").alias("valid"))
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - 90) / 15) + 1)
    errors = rows.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("idx") / 15)))).withColumn("error", F.col("sq") * (F.col("window") % 3 + 1))
    return rounded(graph.hop_windows(graph.frame_errors(errors)))


HOPS = f"""with {FRAMES}, w as (select file_index, idx, AU12 * AU12 as sq, is_audio_active, unnest(range(greatest(0, floor((idx - 90) / 15e0) + 1)::bigint, idx // 15 + 1)) as w from frames),
e as (select file_index, idx, avg(sq * (w % 3 + 1)) as error, count(*) as n from w where is_audio_active = 1 group by 1, 2), last as (select file_index, max(idx) + 1 as n from e group by 1),
h as (select e.*, last.n as total, unnest(range(greatest(0, floor((idx - 60) / 30e0) + 1)::bigint, idx // 30 + 1)) as hop from e join last using (file_index))
select file_index, hop as "window", {r("sum(error * n) / nullif(sum(n), 0)")} as error from h where hop * 30 + 60 <= total group by 1, 2"""


def node_graph(spark, d):
    nation = table(spark, d, "nation")
    return graph.prior_adjacency(nation.select(F.col("n_nationkey").cast("long").alias("node")), nation.select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b")))


GRAPH = """with e as (select n_nationkey as a, n_regionkey as b from nation union select n_regionkey, n_nationkey from nation)
select cast(x.n_nationkey as bigint) as a, cast(y.n_nationkey as bigint) as b, case when x.n_nationkey = y.n_nationkey or e.a is not null then 1e0 else 0.05e0 end as weight
from nation x cross join nation y left join e on e.a = x.n_nationkey and e.b = y.n_nationkey"""


def _faces(spark, d):
    """Vectors as faces, four to a frame of 100 ms; a kind is a file."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("file_index"), (F.floor(F.col("vec_id") / 40) * 100).alias("t_ms"), F.col("vec_id").alias("face_id"), "embedding",
        F.abs(F.get(e, F.lit(0))).cast("double").alias("mar"), (F.get(e, F.lit(1)) * 200).cast("double").alias("yaw"), F.get(e, F.lit(2)).cast("double").alias("score"),
    )


_FACES = """fc as (select label as file_index, vec_id // 40 * 100 as t_ms, vec_id as face_id, embedding::double[] as v, abs(embedding[1])::double as mar, embedding[2]::double * 200 as yaw, embedding[3]::double as score from embeddings),
pf as (select embedding::double[] as p from embeddings where vec_id = 0)"""
_SAID = """sp as (select label as file_index, vec_id * 10 as s, vec_id * 10 + 30 as e from embeddings where vec_id % 7 = 0)"""


def _with_profile(spark, d):
    p = table(spark, d, "embeddings").where("vec_id = 0").limit(1).select(F.col("embedding").alias("_profile"))
    return _faces(spark, d).crossJoin(F.broadcast(p))


def _said(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 7 = 0").select(F.col("label").cast("long").alias("file_index"), (F.col("vec_id") * 10).alias("start_ms"), (F.col("vec_id") * 10 + 30).alias("end_ms"))


def best_faces(spark, d):
    rows = _with_profile(spark, d).withColumnRenamed("t_ms", "frame")
    return rounded(enroll.best_face(rows, F.col("_profile"), least=0.1).select("file_index", "frame", "face_id", "sim"), 5)


BEST = f"""with {_FACES}, s as (select *, list_cosine_similarity(v, p) as sim from fc, pf), n as (select *, row_number() over (partition by file_index, t_ms order by sim desc, face_id) as n from s)
select file_index, t_ms as frame, face_id, {r("sim", 5)} as sim from n where n = 1 and sim >= 0.1"""


def _seen(spark, d):
    """Observations of faces of which every third is mixed with the profile, so that it is like it."""
    rows = _with_profile(spark, d)
    mixed = F.zip_with("embedding", "_profile", lambda x, y: x.cast("double") + F.when(F.col("face_id") % 3 == 0, F.when(F.col("file_index") % 3 == 0, 0.47).otherwise(0.6)).otherwise(0.0) * y.cast("double"))
    return enroll.observations(rows.withColumn("embedding", mixed), _said(spark, d), F.col("_profile"), None)


def observation_stream(spark, d):
    return rounded(_seen(spark, d).select("file_index", "t_ms", "here", "sim", "turned", "mar", "other_here", "other_mar", "speech", "anti_centre"), 6)


_OBS = f"""{_FACES}, {_SAID}, fo as (select fc.* replace ([x[1] + x[2] * case when face_id % 3 = 0 then case when file_index % 3 = 0 then 0.47e0 else 0.6e0 end else 0e0 end for x in list_zip(v, p)] as v), p from fc, pf),
s as (select *, list_cosine_similarity(v, p) as sim from fo), n as (select *, row_number() over (partition by file_index, t_ms order by sim desc, face_id) = 1 and sim >= 0.4 as mine from s),
o as (select *, not mine and row_number() over (partition by file_index, t_ms order by case when not mine then score end desc nulls last, face_id) = 1 as theirs from n),
a as (select file_index, t_ms, bool_or(mine) as here, max(case when mine then sim end) as sim, coalesce(abs(max(case when mine then yaw end)) > 35, false) as turned, max(case when mine then mar end) as mar, bool_or(theirs) as other_here, max(case when theirs then mar end) as other_mar from o group by 1, 2),
ob as (select *, exists (select 1 from sp where sp.file_index = a.file_index and t_ms between s - 50 and e + 50) as speech from a)"""
OBSERVED = f"""with {_OBS} select file_index, t_ms, here, {r("sim")} as sim, turned, {r("mar")} as mar, other_here, {r("other_mar")} as other_mar, speech, speech and coalesce(other_mar < 0.1, false) as anti_centre from ob"""


def weak_recognition(spark, d):
    """By file how surely the target was recognised."""
    return rounded(enroll.weak_recognition(_seen(spark, d)))


WEAK = f"""with {_OBS} select file_index, count(case when here then 1 end) as frames, {r("avg(case when here then sim end)")} as mean_sim, coalesce(avg(case when here then sim end) < 0.5, false) as weak from ob group by 1"""


def _like_some(spark, d):
    """Faces, each mixed with the first of its file of the same remainder by five, so that some are alike."""
    rows = _faces(spark, d)
    first = rows.groupBy("file_index", (F.col("face_id") % 5).alias("m")).agg(F.min_by("embedding", "face_id").alias("_c"), F.min("face_id").alias("_f"))
    rows = rows.withColumn("m", F.col("face_id") % 5).join(first, ["file_index", "m"])
    weight = F.when(F.col("face_id") == F.col("_f"), 0.0).otherwise((F.col("face_id") % 4) * 0.35)
    return rows.withColumn("embedding", F.zip_with("embedding", "_c", lambda x, y: x.cast("double") + weight * y.cast("double"))).drop("m", "_c", "_f")


def face_identities(spark, d):
    """How often each identity of a file was seen, and how surely."""
    rows = _like_some(spark, d)
    return rounded(enroll.identities(enroll.cluster_identities(rows), rows))


IDENTITIES = f"""with recursive {_FACES}, mx as (select fc.file_index, face_id, score, [x[1] + x[2] * case when face_id = c.f then 0e0 else (face_id % 4) * 0.35e0 end for x in list_zip(v, c.c)] as v
  from fc join (select file_index, face_id % 5 as m, arg_min(v, face_id) as c, min(face_id) as f from fc group by 1, 2) c on c.file_index = fc.file_index and c.m = face_id % 5),
nb as (select *, row_number() over (partition by file_index order by face_id) as k from mx),
likes as (select a.file_index, a.k, list(b.k order by b.k) filter (where list_cosine_similarity(a.v, b.v) >= 0.4) as l from nb a left join nb b on a.file_index = b.file_index and b.k < a.k group by 1, 2),
run(file_index, k, centres, mine) as (select file_index, 0::bigint, []::bigint[], 0::bigint from fc group by 1 union all
  select run.file_index, run.k + 1, case when hit is null then list_append(centres, run.k + 1) else centres end, coalesce(hit, run.k + 1)
  from run join (select likes.* from likes) likes on likes.file_index = run.file_index and likes.k = run.k + 1, lateral (select list_min(list_intersect(coalesce(likes.l, []), run.centres)) as hit) h),
named as (select run.file_index, nb.score, dense_rank() over (partition by run.file_index order by mine) - 1 as identity from run join nb on nb.file_index = run.file_index and nb.k = run.k),
g as (select file_index, identity, count(*) as n, avg(score) as m from named group by 1, 2)
select file_index, identity::int as identity, n, {r("m")} as mean_score, row_number() over (partition by file_index order by n desc, identity)::int as place from g"""


def anti_clicks(spark, d):
    """A click on every fourth frame, at the middle of its first face's box or beside all of them."""
    faces = _with_profile(spark, d).withColumn("sim", cosine(F.zip_with("embedding", "_profile", lambda x, y: x.cast("double") + F.when(F.col("face_id") % 3 == 0, 0.6).otherwise(0.0) * y.cast("double")), F.col("_profile")))
    x0 = (F.col("face_id") % 10) * 100.0
    faces = faces.select("file_index", "t_ms", "face_id", "sim", "mar", "score", x0.alias("x0"), F.lit(0.0).alias("y0"), (x0 + 80).alias("x1"), F.lit(80.0).alias("y1"))
    clicks = faces.where("t_ms % 400 = 0").groupBy("file_index", "t_ms").agg(F.min("face_id").alias("click_id"), F.min_by("x0", "face_id").alias("x0"))
    clicks = clicks.select("file_index", "click_id", (F.col("t_ms") + F.when(F.col("click_id") % 11 == 0, 5000).otherwise(30)).alias("t_ms"), (F.col("x0") + 40).alias("x"), F.when(F.col("click_id") % 7 == 0, 300.0).otherwise(40.0).alias("y"))
    return enroll.anti_click_checks(clicks, faces, _said(spark, d)).select("file_index", "click_id", "f_ms", "face_id", "check")


CLICKED = f"""with {_FACES}, {_SAID}, f as (select file_index, t_ms, face_id, list_cosine_similarity([x[1] + x[2] * case when face_id % 3 = 0 then 0.6e0 else 0e0 end for x in list_zip(v, p)], p) as sim, mar, score, face_id % 10 * 100e0 as x0 from fc, pf),
c as (select file_index, min(face_id) as click_id, t_ms + case when min(face_id) % 11 = 0 then 5000 else 30 end as t_ms, arg_min(x0, face_id) + 40 as x, case when min(face_id) % 7 = 0 then 300e0 else 40e0 end as y from f where t_ms % 400 = 0 group by file_index, f.t_ms),
m as (select c.file_index, click_id, f.t_ms as f_ms, face_id, sim, row_number() over (partition by c.file_index, click_id order by abs(c.t_ms - f.t_ms), f.t_ms, (x between x0 and x0 + 80 and y between 0 and 80) desc,
      case when x between x0 and x0 + 80 and y between 0 and 80 then -score else sqrt(pow(x - x0 - 40, 2) + pow(y - 40, 2)) end, face_id) as n from c join f on f.file_index = c.file_index and abs(c.t_ms - f.t_ms) <= 200),
t as (select file_index, t_ms, arg_max(mar, (sim, -face_id)) as mar from f where sim >= 0.4 group by 1, 2)
select c.file_index, c.click_id, f_ms, face_id, case when face_id is null then 'no face' when sim >= 0.4 then 'is the target' when t.mar >= 0.15 then 'target mouth open'
  when not exists (select 1 from sp where sp.file_index = c.file_index and f_ms between s - 50 and e + 50) then 'no speech' else 'ok' end as "check"
from c left join m on m.file_index = c.file_index and m.click_id = c.click_id and n = 1 left join t on t.file_index = c.file_index and t.t_ms = f_ms"""


def frame_timeline(spark, d):
    faces = _faces(spark, d)
    out = report.frame_timeline(faces.select("file_index", "t_ms").distinct(), faces, _said(spark, d))
    first = F.get("faces", F.lit(0))
    return out.select("file_index", "t_ms", "vad", F.size("faces").alias("n"), first["face_id"].alias("face_id"), first["mar"].alias("mar"), first["det"].alias("det"))


TIMELINE = f"""with {_FACES}, {_SAID}, a as (select file_index, t_ms, count(*) as n, min(face_id) as face_id, arg_min(round(mar, 4), face_id) as mar, arg_min(round(score, 3), face_id) as det from fc group by 1, 2)
select file_index, t_ms, exists (select 1 from sp where sp.file_index = a.file_index and t_ms between s - 50 and e + 50) as vad, cast(n as integer) as n, face_id, mar, det from a"""


def mouth_ratios(spark, d):
    points = F.array(*[F.array(F.get("embedding", F.lit(2 * k)).cast("double"), F.get("embedding", F.lit(2 * k + 1)).cast("double")) for k in range(8)])
    return rounded(table(spark, d, "embeddings").select("vec_id", enroll.mouth_ratio(points).alias("mar")), 5)


def _gap(a, b):
    return f"sqrt(pow(e[{2 * a + 1}] - e[{2 * b + 1}], 2) + pow(e[{2 * a + 2}] - e[{2 * b + 2}], 2))"


MOUTHS = f"""with v as (select vec_id, embedding::double[] as e from embeddings)
select vec_id, {r(f"case when {_gap(0, 1)} > 1e-9 then ({_gap(2, 3)} + {_gap(4, 5)} + {_gap(6, 7)}) / 3 / {_gap(0, 1)} end", 5)} as mar from v"""


def anchor_outliers(spark, d):
    """Seeds of the sessions' candidates against the consensus of all others."""
    rows = sessions(spark, d).where("kind in ('seed', 'voice')").select("session", F.col("candidate_id").alias("vec_id"), "vector", "duration_ms", (F.col("candidate_id") % 5 == 0).alias("seed"))
    return rounded(enroll.anchor_outliers(rows, ["session"]), 4)


ANCHORS = f"""with {_LIKE_SEED}, v as (select *, vec_id % 5 = 0 as seed from el where kind in ('seed', 'voice')),
p5 as (select s, p, sum(w * x) as m from v where seed group by 1, 2), c as (select vec_id, sum(x * m) / (any_value(l) * sqrt(sum(m * m))) as sim from v join p5 using (s, p) join size using (vec_id) group by 1),
own as (select v.* from v join c using (vec_id) where seed or sim >= 0.55), t as (select s, p, sum(w * x) as t, count(*) as n from own group by 1, 2),
l as (select vec_id, own.s, any_value(n) as n, sum(x * (t - w * x)) / (any_value(l) * sqrt(sum((t - w * x) * (t - w * x)))) as sim from own join t on t.s = own.s and t.p = own.p join size using (vec_id) where seed group by 1, 2)
select s::varchar as session, vec_id, {r("case when n > 1 then sim end", 4)} as sim, coalesce(case when n > 1 then sim end < 0.65, true) as outlier from l"""


def voice_checks(spark, d):
    """The sessions' candidates by how like the seed they are: how contaminated such a pool were, and whether one for the other voice is left out."""
    rows, _ = pools.enrol(sessions(spark, d))
    return rows.select("session", "candidate_id", enroll.contamination(F.col("sim_seed")).alias("level"), enroll.too_like(F.col("sim_seed")).alias("left_out"))


VOICES = f"""with {_LIKE_SEED} select s::varchar as session, vec_id as candidate_id, case when sim > 0.6 then 'HALT' when sim > 0.45 then 'WARNING' else 'OK' end as level, sim > 0.6 as left_out from like_seed join mixed using (vec_id)"""


def spaced_candidates(spark, d):
    times = intervals(spark, d).select("file_index", F.floor(F.col("start_ms") / 7).alias("t_ms"))
    return enroll.spaced(times, 900).distinct()


SPACED = f"""with recursive {INTERVALS}, x as (select distinct file_index, start_ms // 7 as t from intervals), nx as (select file_index, t, min(t) over (partition by file_index order by t range between 900 following and unbounded following) as nt from x),
s as (select file_index, min(t) as t from x group by 1 union all select s.file_index, nx.nt from s join nx on nx.file_index = s.file_index and nx.t = s.t where nx.nt is not null)
select file_index, t as t_ms from s"""


def centred_spans(spark, d):
    points = intervals(spark, d).select("file_index", F.col("start_ms").alias("t_ms"))
    return enroll.centred_spans(points, _durations(spark, d)).select("file_index", "t_ms", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


CENTRED = f"""with {DUR}, c as (select i.file_index, start_ms as t_ms, greatest(0, start_ms - 1000) as a, least(duration_ms, start_ms + 1000) as b from intervals i join dur using (file_index))
select file_index, t_ms, a as start_ms, b as end_ms from c where b - a >= 1000"""


def pool_warnings(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("pool"), F.col("user_id").alias("file_index")).agg(F.var_pop(F.col("value") / 100).alias("variance"))
    return rounded(enroll.pool_warnings(rows))


POOL_WARNINGS = f"""with v as (select user_id % 3 as pool, user_id as file_index, var_pop(value / 100) as variance from events group by 1, 2)
select pool, file_index, {r("variance")} as variance, coalesce(variance - lag(variance) over (partition by pool order by file_index) > 0.05, false) as rising, variance > 0.05 as wide from v"""


def plain_profile(spark, d):
    """Profiles of equally weighted vectors."""
    prof = diarize.weighted_profile(pool(spark, d), ["kind"], weight=None)
    return rounded(prof.select("kind", F.posexplode("profile").alias("d", "x")), 5)


PLAIN = f"""with el as (select label as kind, unnest(embedding)::double as x, unnest(range(0, 64)) as dd from embeddings), m as (select kind, dd, avg(x) as m from el group by 1, 2)
select kind, cast(dd as integer) as d, {r("m / sqrt(sum(m * m) over (partition by kind))", 5)} as x from m"""


def entry_hashes(spark, d):
    """Logs of customers whose entries were hashed before some states changed: the first entry of each that shows it."""
    o = table(spark, d, "orders")
    order = W.partitionBy("log").orderBy("o_orderkey")
    log = o.select(F.col("o_custkey").alias("log"), "o_orderkey", "o_orderpriority", "o_orderstatus", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("entry_sha"))
    log = log.withColumns({"seq": (F.row_number().over(order) - 1).cast("long"), "o_orderstatus": F.when(F.col("o_orderkey") % 500 == 1, "X").otherwise(F.col("o_orderstatus"))})
    return audit.recomputed(log, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


HASHES = """with e as (select o_custkey as log, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - 1 as seq from orders)
select log, count(*) as entries, min(case when o_orderkey % 500 = 1 and o_orderstatus <> 'X' then seq end) as first_changed from e group by 1"""


def log_warnings(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_type").alias("kind"), F.col("event_id").alias("ts"))
    return audit.warnings(rows, ["error", "signup"])


LOG_WARNINGS = """select user_id as log, event_type as kind, count(*) as n, min(event_id) as first_ts, max(event_id) as last_ts from events where event_type in ('error', 'signup') group by 1, 2"""


def timeline_bounds(spark, d):
    return audit.bounds(audit.lanes(intervals(spark, d), regions(spark, d), _durations(spark, d)))


BOUNDS = f"""with {DUR}, o as (select file_index, cast(coalesce(sum(duration_ms) over (order by file_index rows between unbounded preceding and 1 preceding), 0) as bigint) as off from dur),
l as (select file_index, start_ms, end_ms from intervals union all select file_index, start_ms + 500, end_ms + 500 from intervals where turn % 3 = 0)
select min(start_ms + off) as g0, max(end_ms + off) as g1 from l join o using (file_index)"""


def tier_reasons(spark, d):
    rows = _tiers(spark, d)
    return rows.select("file_index", "block", audit.reason(F.col("tier"), F.round(F.col("s_target") * 100, 1), F.round(F.col("s_interviewer") * 100, 1), F.lit(55.0), F.col("margin_failed")).alias("reason"))


REASONS = f"""with {TIERS} select file_index, block, case when tier = 'HIGH' then printf('target score %.2f above %.2f', s_target * 100, 55e0) when tier = 'MEDIUM' and margin_failed then printf('target score %.2f, but the other voice scores %.2f', s_target * 100, s_interviewer * 100)
  when tier = 'SKIPPED' then 'too little speech to score' else printf('target score %.2f', s_target * 100) end as reason from tiers"""


def unwrapped_records(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.lit("w").alias("worker"), F.lit("op").alias("operation"), F.col("o_orderstatus").alias("payload")))).otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("payload")))).alias("record"))
    return audit.unwrap(rows).select("o_orderkey", "body")


UNWRAPPED = """select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus else '{"payload":"' || o_orderstatus || '"}' end as body from orders"""


def lane_gate(spark, d):
    lanes = frames(spark, d).groupBy("recording_id").agg(F.count("*").alias("n"))
    fits = table(spark, d, "supplier").where("s_suppkey <= 8").select((F.col("s_suppkey") % 10).alias("recording_id"), (F.col("s_suppkey") / 8.0).alias("ratio"))
    return report.lane_gate(lanes, fits).select("recording_id", "n", "why", "shown")


LANE_GATE = f"""with {FRAMES}, l as (select recording_id, count(*) as n from frames group by 1), f as (select s_suppkey % 10 as recording_id, s_suppkey / 8e0 as ratio from supplier where s_suppkey <= 8)
select recording_id, n, case when ratio is null then 'no fit report' when ratio >= 0.9 then printf('fit ratio %.2f is not below %.2f', ratio, 0.9e0) else 'ok' end as why, coalesce(ratio < 0.9, false) as shown from l left join f using (recording_id)"""


def clip_traces(spark, d):
    rows = windows.complete_windows(frames(spark, d)).select("recording_id", "file_index", "window_id", (F.col("n") / 7).alias("v"))
    return report.traces(rows, "v").select("recording_id", "file_index", F.size("trace").alias("n"), F.round(F.aggregate("trace", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.get("trace", F.lit(0)).alias("first"))


TRACES = f"""with {FRAMES}, a as (select recording_id, file_index, mt, unnest(range(greatest(0, floor((t - 2000) / 1000) + 1)::bigint, least(floor(t / 1000), ceil(mt / 1000) - 1)::bigint + 1)) as k from (select *, max(t) over (partition by file_index) as mt from frames)),
c as (select recording_id, file_index, k, round(count(*) / 7e0, 4) as v from a where k * 1000 + 2000 <= mt group by 1, 2, 3)
select recording_id, file_index, cast(count(*) as integer) as n, round(sum(v), 2) as total, arg_min(v, k) as first from c group by 1, 2"""


def report_facts(spark, d):
    w = windows.window_table(frames(spark, d)).withColumn("flat_mean", F.when(F.col("recording_id") % 2 == 0, 1.0).otherwise(F.col("AU12_mean")))
    return report.report_facts(w, calibrate.fit_baseline(w, ["AU12_mean", "AU6_mean", "flat_mean"]))


FACTS = f"""with {WINDOWS}, f as (select recording_id, min(file_index) as baseline, count(distinct file_index) as clips, count(*) as windows from windows group by 1),
b as (select recording_id, stddev_samp(AU12_mean) as s12, stddev_samp(AU6_mean) as s6, stddev_samp(case when recording_id % 2 = 0 then 1 else AU12_mean end) as sf from windows join f using (recording_id) where file_index = baseline group by 1)
select recording_id, baseline, clips, f.windows, concat_ws(',', case when coalesce(s12, 0) = 0 then 'AU12_mean' end, case when coalesce(s6, 0) = 0 then 'AU6_mean' end, case when coalesce(sf, 0) = 0 then 'flat_mean' end) as uncalibrated from f join b using (recording_id)"""


def full_windows(spark, d):
    """The whole window table with all ten channels, indices, gaze entropy, the spectrum of one channel and an acoustic block."""
    rows = frames(spark, d)
    sound = windows.spine(rows).select("recording_id", "file_index", "k", ((F.col("k") * 7 + F.col("file_index")) % 11 / 10.0).alias("spread"))
    out = windows.full_table(rows, windows.Sliding(channels=WIDE), acoustic=sound).drop("start_time_ms", "end_time_ms", "emotion_label_mode")
    fine = {c: (nearest(F.col(c), 9) + 0.0) for c in _FULL}
    return out.select(*[fine.get(c, nearest(F.col(c), 6) + 0.0 if t == "double" else F.col(c)).alias(c) for c, t in out.dtypes])


_FULL = [f"{c}_{s}" for c in WIDE for s in ("mean", "max", "min", "var")]
_SPECTRAL = [f"gaze_x_{b}_{m}" for b in ("tremor", "sway") for m in ("power", "peak", "entropy")]
FULL = f"""with {windows_sql(WIDE)}, ge as (select * from ({ENTROPY})), fx as (select * from ({SPECTRUM}))
select w.recording_id, w.file_index, w.window_id, frame_count, {r("cumulative_confidence")} as cumulative_confidence, blink_count, {r("active_ratio")} as active_ratio, {", ".join(f"{r(f, 9)} as {f}" for f in _FULL)}, {_INDEX_SQL},
  {r(_STILL)} as postural_freeze_index, {r("case when cumulative_confidence >= 15 then ge.entropy end")} as gaze_entropy, {", ".join(f"{r(f'case when cumulative_confidence >= 15 then fx.{x} end')} as {x}" for x in _SPECTRAL)},
  {r("case when cumulative_confidence >= 15 and (active_ratio is null or active_ratio >= 0.5) then (w.window_id * 7 + w.file_index) % 11 / 10e0 end")} as spread
from windows w left join ge on ge.file_index = w.file_index and ge.k = w.window_id left join fx on fx.file_index = w.file_index and fx.window_id = w.window_id"""

ALL = {
    "midpoint_labels": (midpoint_labels, MIDPOINTS),
    "usable_clips": (usable_clips, USABLE),
    "guarded_recordings": (guarded_recordings, GUARDED),
    "channel_ranking": (channel_ranking, RANKING),
    "coupling_bars": (coupling_bars, BARS),
    "loso_flags": (loso_flags, None),
    "loso_weights": (loso_weights, None),
    "pure_windows": (pure_windows, PURE),
    "loso_verdict": (loso_verdict, VERDICT),
    "graph_losses": (graph_losses, LOSSES),
    "zero_reference": (zero_reference, ZERO),
    "hop_errors": (hop_errors, HOPS),
    "node_graph": (node_graph, GRAPH),
    "best_faces": (best_faces, BEST),
    "observation_stream": (observation_stream, OBSERVED),
    "weak_recognition": (weak_recognition, WEAK),
    "face_identities": (face_identities, IDENTITIES),
    "anti_clicks": (anti_clicks, CLICKED),
    "frame_timeline": (frame_timeline, TIMELINE),
    "mouth_ratios": (mouth_ratios, MOUTHS),
    "anchor_outliers": (anchor_outliers, ANCHORS),
    "voice_checks": (voice_checks, VOICES),
    "spaced_candidates": (spaced_candidates, SPACED),
    "centred_spans": (centred_spans, CENTRED),
    "pool_warnings": (pool_warnings, POOL_WARNINGS),
    "plain_profile": (plain_profile, PLAIN),
    "entry_hashes": (entry_hashes, HASHES),
    "log_warnings": (log_warnings, LOG_WARNINGS),
    "timeline_bounds": (timeline_bounds, BOUNDS),
    "tier_reasons": (tier_reasons, REASONS),
    "unwrapped_records": (unwrapped_records, UNWRAPPED),
    "lane_gate": (lane_gate, LANE_GATE),
    "clip_traces": (clip_traces, TRACES),
    "report_facts": (report_facts, FACTS),
    "full_windows": (full_windows, FULL),
}

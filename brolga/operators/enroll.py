"""Enrolment of a voice: gates, spans, mouth traces and the capture of candidate windows."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import cosine, island
from brolga.functions.prefix import sum_before


def best_face(faces: DataFrame, profile: Column, least: float = 0.40) -> DataFrame:
    """By frame the face (face_id, embedding) most like the profile, if it is like enough; ties to the smaller id."""
    rows = faces.withColumn("sim", cosine(F.col("embedding"), profile))
    best = F.row_number().over(W.partitionBy("file_index", "frame").orderBy(F.desc("sim"), "face_id"))
    return rows.withColumn("_n", best).where((F.col("_n") == 1) & (F.col("sim") >= least)).drop("_n")


def mouth_ratio(points: Column) -> Column:
    """Mean of three vertical lip distances over the mouth's width, from eight (x, y) points: corners, then three pairs."""
    gap = lambda a, b: F.sqrt((points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2)
    return F.when((F.size(points) >= 8) & (gap(0, 1) > 1e-9), (gap(2, 3) + gap(4, 5) + gap(6, 7)) / 3 / gap(0, 1))


def triple_gate(rows: DataFrame, seed: str, anti: str | None, coverage: float = 0.5, closed: float = 0.8, least_seed: float = 0.70, most_anti: float = 0.50, margin: float = 0.15) -> DataFrame:
    """rows with accepted and failed_gate: A for too little speech or an open mouth beside, B unlike the seed, C like the other."""
    a = (F.col("vad_coverage") < coverage) | F.coalesce(F.col("closed_share") < closed, F.lit(False))
    c = (F.col(anti) > most_anti) | (F.col(seed) - F.col(anti) < margin) if anti else F.lit(False)
    failed = F.when(a, "A").when(F.col(seed) < least_seed, "B").when(F.coalesce(c, F.lit(False)), "C")
    return rows.withColumns({"failed_gate": failed, "accepted": failed.isNull()})


def solo_spans(rows: DataFrame, step: float, least: float = 2000) -> DataFrame:
    """Stretches of solo frames (file_index, t_ms, solo), split where over three steps are missing, of `least` ms or more."""
    order = W.partitionBy("file_index").orderBy("t_ms")
    on = rows.where("solo")
    on = on.withColumn("_new", F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > 3 * step, F.lit(True)))
    on = on.withColumn("_run", island(F.col("_new"), order))
    out = on.groupBy("file_index", "_run").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count("*").alias("n"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= least).drop("_run")


def quality(pools: DataFrame, strong: int = 45_000, marginal: int = 20_000, variance: float = 0.05, anti: bool = True, strong_alone: int = 60_000) -> DataFrame:
    """pools (ms, variance) with quality; without a profile of the other voice (anti), STRONG takes more."""
    enough = F.col("ms") >= (strong if anti else strong_alone)
    q = F.when(enough & (F.col("variance") <= variance), "STRONG").when(F.col("ms") >= marginal, "MARGINAL").otherwise("INSUFFICIENT")
    return pools.withColumn("quality", q)


def contamination(sim: Column) -> Column:
    return F.when(sim > 0.60, "HALT").when(sim > 0.45, "WARNING").otherwise("OK")


def spaced(rows: DataFrame, least: int = 2000) -> DataFrame:
    """rows (file_index, t_ms) taken greedily from the first on, each at least so long after the last one taken.

    What is taken depends on all before it, so a file's candidates, some thousands an hour, are one group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        took, last = [], None
        for t in sorted(pdf.t_ms.dropna().astype("int64").unique()):
            if last is None or t - last >= least:
                took.append(t)
                last = t
        return pd.DataFrame({"file_index": pdf.file_index.iloc[0], "t_ms": took})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("file_index", "t_ms"))
    took = rows.select("file_index", "t_ms").groupBy("file_index").applyInPandas(one, kinds)
    return rows.join(took, ["file_index", "t_ms"], "left_semi")


def centred_spans(rows: DataFrame, durations: DataFrame, half: int = 1000) -> DataFrame:
    """Spans of half ms to both sides of t_ms, cut to the file; dropped if under half of that is left."""
    out = rows.join(durations, "file_index").select("file_index", "t_ms", F.greatest(F.lit(0), F.col("t_ms") - half).alias("start_ms"), F.least("duration_ms", F.col("t_ms") + half).alias("end_ms"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= half)


def nearest_face(clicks: DataFrame, faces: DataFrame, within: int = 200) -> DataFrame:
    """For each click (file_index, click_id, t_ms, x, y) the face of the nearest frame, the one whose box holds it before the closest centre."""
    near = faces.withColumnRenamed("t_ms", "f_ms")
    cell = lambda c: F.floor(F.col(c) / within)
    wide = clicks.withColumn("_c", F.explode(F.array(cell("t_ms") - 1, cell("t_ms"), cell("t_ms") + 1)))
    rows = wide.join(near.withColumn("_c", cell("f_ms")), ["file_index", "_c"]).withColumn("gap", F.abs(F.col("t_ms") - F.col("f_ms"))).where(F.col("gap") <= within)
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    off = F.sqrt((F.col("x") - (F.col("x0") + F.col("x1")) / 2) ** 2 + (F.col("y") - (F.col("y0") + F.col("y1")) / 2) ** 2)
    best = W.partitionBy("file_index", "click_id").orderBy("gap", "f_ms", F.desc(inside), F.when(inside, -F.col("score")).otherwise(off), "face_id")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("file_index", "click_id", "f_ms", "face_id", inside.alias("inside"))


def cluster_identities(faces: DataFrame, least: float = 0.40) -> DataFrame:
    """faces (file_index, face_id, embedding) with identity: the first one whose first face is like enough, in order of face_id.

    An identity's centre is its first face and stays it; a face like none before begins the next. What a face joins
    depends on all before it, so a file is one group, whose centres alone are compared with.
    """
    import numpy as np

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("face_id")
        centres: list = []
        out = []
        for v in pdf.embedding:
            v = np.asarray(v if v is not None else [], float)
            v = v / (np.sqrt(v @ v) or 1)
            like = np.flatnonzero(np.stack(centres) @ v >= least) if centres else []
            if not len(like):
                centres.append(v)
            out.append(int(like[0]) if len(like) else len(centres) - 1)
        return pdf[["file_index", "face_id"]].assign(identity=out)

    return faces.select("file_index", "face_id", "embedding").groupBy("file_index").applyInPandas(one, "file_index long, face_id long, identity int")


def identities(clustered: DataFrame, scores: DataFrame) -> DataFrame:
    """(file_index, identity, n, mean_score, place): how often each identity was seen and how surely, the most seen first.

    scores: (file_index, face_id, score). Ties in n go to the identity that came first.
    """
    rows = clustered.join(scores, ["file_index", "face_id"]).groupBy("file_index", "identity").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("file_index").orderBy(F.desc("n"), "identity")))


def smoothed(rows: DataFrame, value: str, here: str, still: str | None = None, span: int = 5, memory: int = 120, name: str = "smoothed") -> DataFrame:
    """rows (file_index, t_ms, value, here, still) with the exponential mean of the values so far.

    It begins anew with the first value after an absence (here false, where it is null), and stays as it is where there is
    no value or `still` holds. What lies `memory` values back weighs (1 - 2/(span+1))**memory, nothing at all in doubles.
    """
    order = W.partitionBy("file_index").orderBy("t_ms")
    off = ~F.coalesce(F.col(here), F.lit(False))
    hold = F.coalesce(F.col(still), F.lit(False)) if still else F.lit(False)
    cut = rows.withColumn("_run", F.sum(off.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.withColumn("_v", F.when(~off & ~hold, F.col(value).cast("double"))).withColumn("_some", F.col("_v").isNotNull())
    past = F.collect_list("_v").over(W.partitionBy("file_index", "_run", "_some").orderBy("t_ms").rowsBetween(-(memory - 1), 0))
    a = 2.0 / (span + 1)
    mean = F.aggregate(F.slice("_p", 2, memory), F.get("_p", F.lit(0)), lambda s, x: s + a * (x - s))
    told = cut.withColumn("_p", F.when(F.col("_some"), past)).withColumn("_m", F.when(F.col("_some"), mean))
    inside = W.partitionBy("file_index", "_run").orderBy("t_ms").rowsBetween(W.unboundedPreceding, 0)
    out = F.when(~off, F.last("_m", ignorenulls=True).over(inside))
    return told.withColumn(name, out).select(*rows.columns, name)


@dataclass
class Capture:
    """Candidate windows from what is seen of two mouths, one observation after another.

    A window opens when the target's smoothed mouth opens while there is speech. When speech or the mouth stops, it stays open
    for hold ms more, in case that goes on; the clock of that stands still while the head is turned. It ends at that deadline,
    at once if the other one starts to talk, or with the video. Smoothed values start anew after an absence and stand still
    while the head is turned.
    """

    on: float = 0.15
    off: float = 0.10
    hold: int = 500
    span: int = 5
    target: float | None = None
    other: float | None = None
    opened: int | None = None
    deadline: int | None = None
    before: int | None = None
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])

    def smooth(self, old: float | None, new: float) -> float:
        return new if old is None else old + 2 / (self.span + 1) * (new - old)

    def close(self, at: int, why: str) -> tuple:
        out = (self.opened, at, why, *self.counts)
        self.opened = self.deadline = None
        self.counts = [0, 0, 0]
        return out

    def see(self, t: int, here: bool, turned: bool, mar: float | None, other_here: bool, other_mar: float | None, speech: bool) -> list[tuple]:
        """Windows (start, stop, why, frames, frames with the other, of these with a closed mouth) that end at t."""
        if not other_here:
            self.other = None
        elif other_mar is not None:
            self.other = self.smooth(self.other, other_mar)
        if not here:
            self.target = None
        elif mar is not None and not turned:
            self.target = self.smooth(self.target, mar)
        talks = here and self.target is not None and self.target > self.on and speech
        done: list[tuple] = []
        if self.opened is not None:
            if self.deadline is None:
                quiet = not here or not speech or (self.target is not None and self.target < self.off)
                if quiet and not turned:
                    self.deadline = t + self.hold
            elif turned:
                self.deadline += t - (t if self.before is None else self.before)
            elif t >= self.deadline:
                done.append(self.close(self.deadline, "expired"))
            elif other_here and self.other is not None and self.other > self.on:
                done.append(self.close(t, "interjection"))
            elif talks:
                self.deadline = None
        if self.opened is None and talks and not turned:
            self.opened = t
        if self.opened is not None:
            shut = other_here and self.other is not None and self.other < self.off
            self.counts = [self.counts[0] + 1, self.counts[1] + int(other_here), self.counts[2] + int(shut)]
        self.before = t
        return done

    def finish(self) -> list[tuple]:
        return [self.close(self.before, "end")] if self.opened is not None else []


CAPTURED = "file_index long, start_ms long, stop_ms long, reason string, frames int, other_frames int, other_closed int"
SEEN = ["t_ms", "here", "turned", "mar", "other_here", "other_mar", "speech"]


def observe(machine: Capture, rows: pd.DataFrame) -> list[tuple]:
    """Feeds observations in order of time to a machine: the same for batches and streams."""
    out: list[tuple] = []
    none = lambda x: None if x is None or x != x else float(x)
    for t, here, turned, mar, other_here, other_mar, speech in rows.sort_values("t_ms")[SEEN].itertuples(index=False):
        out += machine.see(int(t), bool(here), bool(turned), none(mar), bool(other_here), none(other_mar), bool(speech))
    return out


def capture_windows(observations: DataFrame) -> DataFrame:
    """Candidate windows of each file, from observations (file_index, SEEN); a file is one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        machine = Capture()
        rows = observe(machine, pdf) + machine.finish()
        cols = [x.split()[0] for x in CAPTURED.split(", ")]
        return pd.DataFrame([(pdf.file_index.iloc[0], *r) for r in rows], columns=cols)

    return observations.select("file_index", *SEEN).groupBy("file_index").applyInPandas(one, CAPTURED)


def discards(spans: DataFrame, seed: DataFrame, least: int = 2000) -> DataFrame:
    """spans (file_index, start_ms, end_ms) with why they are left out: over a seed span, or too short; null if kept."""
    from brolga.operators.diarize import coverage

    rows = coverage(spans, seed, ["file_index"])
    why = F.when(F.col("covered_ms") > 0, "seed overlap").when(F.col("end_ms") - F.col("start_ms") < least, "too short")
    return rows.withColumn("why", why).drop("covered_ms")


def anchored(spans: DataFrame, seed: str = "s_target", anti: str | None = "s_interviewer", least: float = 0.78, most: float = 0.50, margin: float = 0.15) -> DataFrame:
    """spans with reason: 'accepted', or the first bound that their scores fail."""
    far = F.when(F.col(anti) > most, "anti").when(F.col(seed) - F.col(anti) < margin, "margin") if anti else F.lit(None).cast("string")
    return spans.withColumn("reason", F.coalesce(F.when(F.col(seed) < least, "seed"), far, F.lit("accepted")))


def pool_warnings(pools: DataFrame, rise: float = 0.05, most: float = 0.05) -> DataFrame:
    """pools (file_index, variance) with rising, against the file before, and wide."""
    before = F.lag("variance").over(W.partitionBy("pool").orderBy("file_index"))
    return pools.withColumns({"rising": F.coalesce(F.col("variance") - before > rise, F.lit(False)), "wide": F.col("variance") > most})


def seed_checks(spans: DataFrame, least: int = 3000, open_share: float = 0.20) -> DataFrame:
    """Seed spans (start_ms, end_ms, click_ms, other_open) with the first thing wrong with them, or 'ok'."""
    why = (
        F.when((F.col("click_ms") < F.col("start_ms")) | (F.col("click_ms") >= F.col("end_ms")), "click outside")
        .when(F.col("end_ms") - F.col("start_ms") < least, "too short")
        .when(F.col("other_open") > open_share, "other mouth open")
        .otherwise("ok")
    )
    return spans.withColumn("check", why)


def grow_pools(scores: DataFrame, least: float = 0.55) -> DataFrame:
    """By file, what the pools hold after it: how many vectors and how long, over all files so far."""
    taken = scores.where(F.col("sim") >= least).groupBy("file_index").agg(F.count("*").alias("_n"), F.sum("duration_ms").alias("_ms"))
    out = sum_before(taken, "file_index", {"n": F.col("_n"), "ms": F.col("_ms")})
    return out.select("file_index", (F.col("n") + F.col("_n")).alias("n"), (F.col("ms") + F.col("_ms")).alias("ms"))


def too_like(sim: Column, most: float = 0.60) -> Column:
    """Whether a candidate for the other voice is so like the target that it is left out."""
    return F.coalesce(sim > most, F.lit(False))


def observations(faces: DataFrame, speech: DataFrame, target: Column, other: Column | None, like: float = 0.40, turn: float = 35.0, tolerance: int = 50, closed: float = 0.10) -> DataFrame:
    """What a capture machine sees of each frame (file_index, t_ms): whether the target is there, how like its profile (sim),
    turned away, its mouth; the same of the other one; whether there is speech; and anti_centre, whether the frame may be the
    middle of a span of the other voice: the other one is there with its mouth closed while there is speech.

    faces: (file_index, t_ms, face_id, embedding, mar, yaw, score); speech: (file_index, start_ms, end_ms). The target is the
    face most like its profile, the other one the most like its own among the rest, or without a profile the one of highest
    score; ties go to the smaller face_id. target and other are columns of faces.
    """
    rows = faces.withColumn("_t", cosine(F.col("embedding"), target))
    frame = W.partitionBy("file_index", "t_ms")
    rows = rows.withColumn("_mine", (F.row_number().over(frame.orderBy(F.desc("_t"), "face_id")) == 1) & (F.col("_t") >= like))
    rank = cosine(F.col("embedding"), other) if other is not None else F.col("score")
    rows = rows.withColumn("_o", F.when(~F.col("_mine"), rank))
    fits = (F.col("_o") >= like) if other is not None else F.col("_o").isNotNull()
    rows = rows.withColumn("_theirs", ~F.col("_mine") & (F.row_number().over(frame.orderBy(F.desc_nulls_last("_o"), "face_id")) == 1) & F.coalesce(fits, F.lit(False)))
    one = lambda who, x: F.max(F.when(F.col(who), F.col(x)))
    out = rows.groupBy("file_index", "t_ms").agg(
        F.max("_mine").alias("here"),
        one("_mine", "_t").alias("sim"),
        F.coalesce(F.abs(one("_mine", "yaw")) > turn, F.lit(False)).alias("turned"),
        one("_mine", "mar").alias("mar"),
        F.max("_theirs").alias("other_here"),
        one("_theirs", "mar").alias("other_mar"),
    )
    from brolga.operators.diarize import near_spans

    near = near_spans(out.withColumnRenamed("t_ms", "t"), speech, ["file_index"], tolerance)
    near = near.withColumnRenamed("t", "t_ms").withColumnRenamed("near", "speech")
    return near.withColumn("anti_centre", F.col("speech") & F.coalesce(F.col("other_mar") < closed, F.lit(False)))


def weak_recognition(seen: DataFrame, least: float = 0.50) -> DataFrame:
    """By file of observations the mean likeness of the frames that show the target, and whether it is so low that faces may
    have been mixed up; null and no warning where the target was never seen."""
    mean = F.avg(F.when(F.col("here"), F.col("sim")))
    return seen.groupBy("file_index").agg(F.count(F.when(F.col("here"), 1)).alias("frames"), mean.alias("mean_sim"), F.coalesce(mean < least, F.lit(False)).alias("weak"))


def anti_click_checks(clicks: DataFrame, faces: DataFrame, speech: DataFrame, like: float = 0.40, open_mouth: float = 0.15, tolerance: int = 50, within: int = 200) -> DataFrame:
    """Clicks on the other voice's face (file_index, click_id, t_ms, x, y) with the frame and face they mean, and the first thing
    wrong with them, or 'ok'.

    faces: (file_index, t_ms, face_id, sim, mar, x0, y0, x1, y1, score), sim the likeness to the target; speech: (file_index,
    start_ms, end_ms). A click must mean a face, not the target's; the target, the most like face of that frame if like
    enough, must not have its mouth open; and speech must be near the frame.
    """
    from brolga.operators.diarize import near_spans

    met = clicks.join(nearest_face(clicks, faces, within), ["file_index", "click_id"], "left")
    own = faces.select("file_index", F.col("t_ms").alias("f_ms"), "face_id", F.col("sim").alias("_sim"))
    rows = met.join(own, ["file_index", "f_ms", "face_id"], "left")
    target = faces.where(F.col("sim") >= like).groupBy("file_index", F.col("t_ms").alias("f_ms")).agg(F.max_by("mar", F.struct("sim", -F.col("face_id"))).alias("_mar"))
    rows = rows.join(target, ["file_index", "f_ms"], "left")
    rows = near_spans(rows.withColumn("t", F.col("f_ms")), speech, ["file_index"], tolerance)
    why = (
        F.when(F.col("face_id").isNull(), "no face")
        .when(F.col("_sim") >= like, "is the target")
        .when(F.col("_mar") >= open_mouth, "target mouth open")
        .when(~F.col("near"), "no speech")
        .otherwise("ok")
    )
    return rows.select("file_index", "click_id", "f_ms", "face_id", why.alias("check"))


def anchor_outliers(pool: DataFrame, by: list[str], collect: float = 0.55, least: float = 0.65) -> DataFrame:
    """Seeds of a pool (by, vec_id, vector, duration_ms, seed) with sim, their cosine to the consensus of all others, and outlier.

    The weighted mean of the seeds collects the vectors at least `collect` like it; these and the seeds are the consensus,
    of which each seed is left out once. outlier: sim under `least`, or none because a seed is alone.
    """
    from brolga.operators.diarize import leave_one_out, weighted_profile

    first = weighted_profile(pool.where("seed"), by).withColumnRenamed("profile", "_p")
    own = pool.join(first, by).where(F.col("seed") | (cosine(F.col("vector"), F.col("_p")) >= collect)).drop("_p")
    told = leave_one_out(own, by).where("seed").select(*by, "vec_id", F.col("loo").alias("sim"))
    rows = pool.where("seed").select(*by, "vec_id").join(told, [*by, "vec_id"], "left")
    return rows.withColumn("outlier", F.coalesce(F.col("sim") < least, F.lit(True)))

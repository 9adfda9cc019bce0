"""Channel graph: standardised node features with masks, masked errors, neighbour predictors, residual attribution."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.vectors import cross_moments


def feature_stats(long: DataFrame) -> DataFrame:
    """(recording_id, channel): mean (0 without values) and sample deviation (1 if there is hardly any)."""
    sd = F.stddev_samp("value")
    return long.groupBy("recording_id", "channel").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.when(F.coalesce(sd, F.lit(0.0)) < 1e-8, 1.0).otherwise(sd).alias("sd"))


#: How sure the face must be for the channels of its nodes to count.
FACE_SURE = 0.30


class TooFewWindows(ValueError):
    """There are not enough windows to fit a model on."""


def standardised(frames: DataFrame, channels: list[str], voice: tuple[str, ...] = (), face: tuple[str, ...] = (), sure: float = FACE_SURE) -> DataFrame:
    """(file_index, idx, channel): z and valid; z is 0 where it is not valid.

    A value is valid if it is there, and, for the channels of the voice node, the voice is active, for those of face nodes,
    the face is sure enough (missing: not). Without a column is_audio_active, or face_confidence, that mask lets all pass. Statistics
    are told to each clip, so that frames are joined, and their channels become rows, where the clip lies.
    """
    voiced = F.coalesce(F.col("is_audio_active") == 1, F.lit(False)) if "is_audio_active" in frames.columns else F.lit(True)
    seen = F.coalesce(F.col("face_confidence") >= sure, F.lit(False)) if "face_confidence" in frames.columns else F.lit(True)
    # what masks a channel is settled before the channels become rows
    kept = lambda c: F.col(c) if c not in (*voice, *face) else F.when(voiced if c in voice else seen, F.col(c))
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])).alias("_c")
    stats = feature_stats(frames.select("recording_id", every).select("recording_id", "_c.channel", "_c.value"))
    stats = stats.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "sd")))).alias("_stats"))
    clips = frames.select("recording_id", "file_index").distinct().join(stats, "recording_id")
    clips = clips.groupBy("file_index").agg(F.map_from_entries(F.collect_list(F.struct("recording_id", "_stats"))).alias("_of"))
    rows = frames.select("recording_id", "file_index", "idx", *[kept(c).cast("double").alias(c) for c in channels]).join(clips, "file_index")
    rows = rows.withColumn("_stats", F.col("_of")[F.col("recording_id")]).where("_stats is not null")
    told = lambda c, s: F.struct(F.lit(c).alias("channel"), F.col(c).isNotNull().cast("int").alias("valid"), F.coalesce((F.col(c) - s["mean"]) / s["sd"], F.lit(0.0)).alias("z"))
    each = F.explode(F.array(*[told(c, F.col("_stats")[c]) for c in channels])).alias("_c")
    return rows.select("file_index", "idx", each).select("file_index", "idx", "_c.channel", "_c.valid", "_c.z")


def _in_windows(long: DataFrame, by: list[str], rows: int, stride: int, *sums: Column) -> DataFrame:
    """Sums (by, window) over the stretches that windows of `rows` frames every `stride` are made of: a row for each stretch and
    window that holds it."""
    width = gcd(rows, stride)
    cells = long.groupBy(*by, F.floor(F.col("idx") / width).alias("_cell")).agg(*sums)
    first = F.greatest(F.lit(0), F.floor((F.col("_cell") * width - rows) / stride) + 1)
    return cells.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("_cell") * width / stride)))).drop("_cell")


def model_windows(long: DataFrame, rows: int = 90, stride: int = 15, least: float = 0.2) -> DataFrame:
    """(file_index, window): windows of so many frames of a clip whose values are valid often enough."""
    clip = W.partitionBy("file_index")
    at = _in_windows(long, ["file_index", "channel"], rows, stride, F.sum("valid").alias("valid"), F.max("idx").alias("_last"))
    at = at.withColumns({"_n": F.max("_last").over(clip) + 1, "channels": F.size(F.collect_set("channel").over(clip))})
    at = at.where(F.col("window") * stride + rows <= F.col("_n"))
    return at.groupBy("file_index", "window", "channels").agg(F.sum("valid").alias("valid")).where(F.col("valid") >= least * rows * F.col("channels")).drop("channels")


def temporal_split(windows: DataFrame, share: float = 0.8) -> DataFrame:
    """windows with train: the first part of each clip's."""
    clip = W.partitionBy("file_index")
    n = F.row_number().over(clip.orderBy("window"))
    return windows.withColumn("train", n <= F.floor(F.count("*").over(clip) * share))


def check_windows(windows: DataFrame, by: list[str], least: int = 20) -> None:
    """Raises TooFewWindows for the first group of model windows that is too short to fit a model on, or if there are none."""
    few = windows.groupBy(*by).count().where(F.col("count") < least).orderBy("count", *by).first()
    if few:
        raise TooFewWindows(f"{', '.join(f'{c} {few[c]}' for c in by)}: {few['count']} windows, {least} are needed")
    if windows.isEmpty():
        raise TooFewWindows(f"no windows, {least} are needed")


def masked_error(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean square of predicted - z over the valid values (error), 0 without any; and how many are valid (n). Without by each row
    is told by itself, as where a node has one channel: nothing is grouped."""
    sq = F.when(F.col("valid") == 1, (F.col("predicted") - F.col("z")) * (F.col("predicted") - F.col("z")))
    if by is None:
        return rows.withColumns({"error": F.coalesce(sq, F.lit(0.0)), "n": sq.isNotNull().cast("long")})
    return rows.groupBy(*by).agg((F.coalesce(F.sum(sq), F.lit(0.0)) / F.greatest(F.lit(1), F.count(sq))).alias("error"), F.count(sq).alias("n"))


def weighted_loss(errors: DataFrame, by: list[str], weight: str, target: bool = False) -> DataFrame:
    """Mean error by weight. With target, errors (error, n) are those of the one node that was to be told, and a frame of which
    nothing is valid there weighs nothing: it is no error of 0."""
    w = F.when(F.col("n") > 0, F.col(weight)).otherwise(0.0) if target else F.col(weight)
    return errors.groupBy(*by).agg((F.sum(F.col("error") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"))


def coupling_ratio(model: DataFrame, zero: DataFrame, by: list[str], healthy: float = 0.90) -> DataFrame:
    """Loss of the model over that of predicting nothing; healthy below the bound."""
    out = model.join(zero.withColumnRenamed("loss", "zero_loss"), by).withColumn("ratio", F.try_divide("loss", "zero_loss"))
    return out.withColumn("healthy", F.col("ratio") < healthy)


def neighbour_models(frames: DataFrame, channels: list[str], by: list[str] | None = None, reg: float = 0.1) -> DataFrame:
    """(by, channel, neighbour, weight): ridge regression of each channel on all others over complete frames, by group.

    Channels are scaled to deviation 1 for the penalty `reg` on squared weights beside the mean square; weights are for the
    values as they are, with the row '(intercept)'. A channel that does not vary tells nothing and weighs 0. One pass sums the
    products of all channels; every model of a group is solved from those sums, so work does not grow with the models. A
    group without a complete frame has no rows.
    """
    import numpy as np
    import pandas as pd

    by = by or []
    told = cross_moments(frames, by, channels)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            n, s, m = row.n, np.asarray(row.s), np.asarray(row.m).reshape(len(channels), -1)
            mean = s / n
            cov = m / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1), sd, 0)
            r = cov / np.where(sd > 0, sd, 1)[:, None] / np.where(sd > 0, sd, 1)[None, :]
            for k, c in enumerate(channels):
                rest = [j for j in range(len(channels)) if j != k and sd[j] > 0]
                beta = np.linalg.solve(r[np.ix_(rest, rest)] + reg * np.eye(len(rest)), r[rest, k]) * sd[k] / sd[rest] if rest and sd[k] > 0 else np.zeros(len(rest))
                weight = dict(zip(rest, beta))
                key = tuple(getattr(row, x) for x in by)
                out += [(*key, c, channels[j], float(weight.get(j, 0.0))) for j in range(len(channels)) if j != k]
                out.append((*key, c, "(intercept)", float(mean[k] - sum(w * mean[j] for j, w in weight.items()))))
        return pd.DataFrame(out, columns=[*by, "channel", "neighbour", "weight"])

    kinds = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in by)
    return told.mapInPandas(lambda parts: (solve(x) for x in parts), f"{kinds}channel string, neighbour string, weight double")


def predicted(rows: DataFrame, models: DataFrame, channels: list[str], on: list[str]) -> DataFrame:
    """rows (on, channels) with predicted_<channel>: what the neighbours tell of it; null if one of them is missing."""
    by = models.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "channel", "neighbour"), "weight"))).alias("_w"))
    w = lambda c, o: F.col("_w")[f"{c}|{o}"]
    out = rows.join(by, on)
    told = {}
    for c in channels:
        total = w(c, "(intercept)")
        for o in channels:
            if o != c:
                total = total + w(c, o) * F.col(o)
        told[f"predicted_{c}"] = total
    return out.withColumns(told).drop("_w")


def frame_errors(errors: DataFrame, rows: int = 90, stride: int = 15) -> DataFrame:
    """Errors (file_index, window, idx, error, valid) of overlapping windows as their mean for each frame; invalid ones are left out."""
    return errors.where("valid = 1").groupBy("file_index", "idx").agg(F.avg("error").alias("error"), F.count("*").alias("n"))


def hop_windows(errors: DataFrame, rows: int = 60, hop: int = 30) -> DataFrame:
    """Complete windows of frame errors: count-weighted means, null where nothing counts."""
    last = errors.groupBy("file_index").agg((F.max("idx") + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - rows) / hop) + 1)
    at = errors.join(last, "file_index").withColumn("window", F.explode(F.sequence(first, F.floor(F.col("idx") / hop)))).where(F.col("window") * hop + rows <= F.col("_n"))
    return at.groupBy("file_index", "window").agg((F.sum(F.col("error") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("error"))


def residual_table(errors: DataFrame, baseline: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """Errors (by, on, node, error) against a baseline's (by, node, error): z by node, and over nodes their sum and maximum.

    by names whose baseline it is, such as a subject: each is told from its own. The same for the features of nodes, if node
    names these. A node without a baseline has no z.
    """
    by = by or []
    base = baseline.groupBy(*by, "node").agg(F.avg("error").alias("m"), (F.stddev_pop("error") + 1e-6).alias("s"))
    z = errors.join(base, [*by, "node"]).withColumn("z", (F.col("error") - F.col("m")) / F.col("s"))
    return z.groupBy(*by, *on).agg(F.map_from_entries(F.collect_list(F.struct("node", "z"))).alias("coupling_z"), F.sum("z").alias("global_z"), F.max("z").alias("max_z"))


def zero_reference(long: DataFrame, split: DataFrame, rows: int = 90, stride: int = 15) -> DataFrame:
    """By clip the loss of predicting nothing (mean square of valid z) over the windows that are not for training.

    long: (file_index, idx, channel, z, valid); split: (file_index, window, train) of temporal_split. A frame counts once
    for each window that holds it.
    """
    sq = F.when(F.col("valid") == 1, F.col("z") * F.col("z"))
    at = _in_windows(long, ["file_index"], rows, stride, F.sum(sq).alias("_sq"), F.count(sq).alias("_n"))
    at = at.join(split.where(~F.col("train")).select("file_index", "window"), ["file_index", "window"])
    return at.groupBy("file_index").agg((F.coalesce(F.sum("_sq"), F.lit(0.0)) / F.greatest(F.lit(1e-6), F.sum("_n").cast("double"))).alias("loss"))


def prior_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight) for all pairs of a fixed small set of nodes: 1 on the diagonal and along edges either way, else 0.05."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().withColumn("edge", F.lit(1))
    pairs = nodes.select(F.col("node").alias("a")).crossJoin(F.broadcast(nodes.select(F.col("node").alias("b"))))
    one = (F.col("a") == F.col("b")) | F.col("edge").isNotNull()
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.when(one, 1.0).otherwise(0.05).alias("weight"))

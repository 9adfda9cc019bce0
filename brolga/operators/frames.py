"""Frame-level features: distances, speeds, fusion, flags, pooling of latents and samples to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import cosine
from brolga.functions.intervals import contain_join


def _clip(order: str = "timestamp"):
    return W.partitionBy("file_index").orderBy(order)


def distance(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Euclidean distance of two points given by their columns; null if a coordinate is."""
    return F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def speed(point: tuple[str, ...]) -> Column:
    """Distance to the frame before in the clip; null on the first frame and beside gaps."""
    steps = [F.col(x) - F.lag(x).over(_clip()) for x in point]
    return F.sqrt(sum((d * d for d in steps), F.lit(0.0)))


def onset(channel: str) -> Column:
    """Change since the frame before; 0 where either is missing."""
    return F.coalesce(F.col(channel) - F.lag(channel).over(_clip()), F.lit(0.0))


def joint_confidence(*parts: Column) -> Column:
    out = F.lit(1.0)
    for p in parts:
        out = out * F.coalesce(p, F.lit(0.0))
    return out


def fuse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames that both streams have, by clip and exact timestamp."""
    return left.join(right, ["file_index", "timestamp"])


def zip_by_position(left: DataFrame, right: DataFrame, order: str = "timestamp") -> DataFrame:
    """The i-th row of a clip in one log with the i-th in the other; what right lacks is null."""
    number = F.row_number().over(_clip(order))
    return left.withColumn("_i", number).join(right.withColumn("_i", number).drop(order), ["file_index", "_i"], "left").drop("_i")


def speech_flag(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """frames with in_speech: 1.0 where a segment (file_index, start_ms, end_ms) contains the timestamp."""
    keys = frames.select("file_index", "timestamp").distinct()
    inside = contain_join(keys, segments.select("file_index", "start_ms", "end_ms"), ["file_index"], "timestamp").select("file_index", "timestamp").distinct()
    marked = inside.withColumn("_in", F.lit(1.0))
    return frames.join(marked, ["file_index", "timestamp"], "left").withColumn("in_speech", F.coalesce("_in", F.lit(0.0))).drop("_in")


def incongruence(audio: Column, lips: Column, pose: Column) -> tuple[Column, Column]:
    """(speech without moving lips, moving lips without speech), both null where there is no pose."""
    yes = lambda x: F.when(pose, F.when(x, 1.0).otherwise(0.0))
    return yes(audio & ~lips), yes(lips & ~audio)


def anchor_speaker(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """For each clip the speaker whose segments hold the most movement: mean(is_moving) * mean(velocity); ties to the first heard."""
    inside = contain_join(frames, segments, ["file_index"], "timestamp")
    scores = inside.groupBy("file_index", "speaker").agg((F.avg("is_moving") * F.avg("velocity")).alias("score"))
    heard = segments.groupBy("file_index", "speaker").agg(F.min("start_ms").alias("first"))
    best = W.partitionBy("file_index").orderBy(F.desc("score"), "first", "speaker")
    return scores.join(heard, ["file_index", "speaker"]).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "first")


def pool_latents(latents: DataFrame, on: list[str], width: float) -> DataFrame:
    """Mean vector of the latents (center_ms, latent) whose centre lies in [t, t+width), t = k*width.

    A latent with a value that is not finite spoils its own interval alone: no mean, count 0.
    """
    bad = F.exists("latent", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = latents.withColumn("k", F.floor(F.col("center_ms") / width)).withColumn("bad", bad)
    state = rows.groupBy(*on, "k").agg(F.max("bad").alias("bad"), F.count("*").alias("n"))
    parts = rows.where(~bad).select(*on, "k", F.posexplode("latent").alias("d", "x"))
    means = parts.groupBy(*on, "k", "d").agg(F.avg("x").alias("x")).groupBy(*on, "k")
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("mean"))
    out = state.join(means, [*on, "k"], "left")
    return out.select(*on, "k", F.when(~F.col("bad"), F.col("mean")).alias("mean"), F.when(F.col("bad"), 0).otherwise(F.col("n")).alias("n"))


def interval_rms(samples: DataFrame, on: list[str], rate: float, width_ms: float) -> DataFrame:
    """Root mean square of samples (sample_idx, x) by interval of width_ms; a value that is not finite spoils its own."""
    k = F.floor(F.col("sample_idx") / (rate * width_ms / 1000))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return samples.groupBy(*on, k.alias("k")).agg(F.when(~F.max(bad), F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"))


def cosine_velocity(latents: DataFrame, on: list[str], order: str, vector: str) -> DataFrame:
    """latents with step: one less the cosine to the row before; null in the first row, 1 beside a vector without length."""
    before = F.lag(vector).over(W.partitionBy(*on).orderBy(order))
    return latents.withColumn("step", F.when(before.isNotNull(), 1 - cosine(F.col(vector), before)))


def group_means(vector: Column, size: int, groups: int) -> Column:
    """Means of contiguous equal parts of a vector."""
    if size % groups:
        raise ValueError(f"{size} does not divide into {groups} groups")
    each = size // groups
    total = lambda g: F.aggregate(F.slice(vector, g * each + 1, each), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: total(g) / each)


def silence_mask(value: Column, n: Column, rms: Column, active: Column, quiet: float = 0.005) -> Column:
    return F.when((n > 0) & (rms >= quiet) & (active == 1), value)


def normalise_clip(x: str, eps: float = 1e-7) -> Column:
    clip = W.partitionBy("file_index")
    return (F.col(x) - F.avg(x).over(clip)) / F.sqrt(F.var_pop(x).over(clip) + eps)


def attenuate(samples: DataFrame, factor: float = 0.05) -> DataFrame:
    """samples with x outside target segments (in_speech 0) made quieter and cut to whole numbers."""
    return samples.withColumn("x", F.when(F.col("in_speech") == 1, F.col("x")).otherwise((F.col("x") * factor).cast("short")))


def block_windows(frames: DataFrame, rows: int = 60) -> DataFrame:
    """Blocks of so many rows of a clip, whole ones only: mean, deviation and greatest of two channels, label mode."""
    number = F.floor((F.row_number().over(_clip()) - 1) / rows)
    stats = [f(c).alias(f"{c}_{n}") for c in ("AU12", "gaze_x") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))]
    out = frames.withColumn("window_id", number).groupBy("file_index", "window_id")
    return out.agg(F.count("*").alias("n"), *stats, F.mode("emotion_label", True).alias("emotion_mode")).where(F.col("n") == rows)

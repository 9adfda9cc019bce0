"""Tables of the analyst's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import nearest


def coverage(rows: DataFrame, channels: list[str], by: str = "recording_id") -> DataFrame:
    """(by, channel): share of values present, and whether the channel is dead or low."""
    long = rows.unpivot([by], channels, "channel", "value")
    n, all_of = F.count("value"), F.count("*")
    return long.groupBy(by, "channel").agg((n / all_of).alias("present"), F.when(n == 0, "dead").when(n * 2 < all_of, "low").otherwise("ok").alias("state"))


def baseline_sanity(windows: DataFrame, channels: int) -> DataFrame:
    """By recording the median deviation of its baseline clip against the root of the channel count; degenerate far below."""
    want = float(channels) ** 0.5
    first = F.min("file_index").over(W.partitionBy("recording_id"))
    base = windows.withColumn("_f", first).where("file_index = _f").groupBy("recording_id").agg(F.median("deviation_magnitude").alias("median_deviation"))
    return base.withColumns({"expected": F.lit(want), "degenerate": F.col("median_deviation") < 0.25 * want})


def flagged(windows: DataFrame, channels: list[str], least: float = 0.95, top: int = 5) -> DataFrame:
    """Windows at or over a percentile with their channels of largest |z| (to six digits, ties by name), largest first."""
    long = windows.where(F.col("deviation_percentile") >= least).unpivot(["recording_id", "window_id", "deviation_percentile"], channels, "channel", "z").where("z is not null")
    n = F.row_number().over(W.partitionBy("recording_id", "window_id").orderBy(F.desc(nearest(F.abs("z"), 6)), "channel"))
    return long.withColumn("place", n).where(F.col("place") <= top)


def channel_groups(long: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(recording_id, grp): median of the channels' medians, and the channel of largest one. long: (recording_id, channel, z)."""
    grp = F.coalesce(*[F.when(F.col("channel").startswith(p), name) for p, name in prefixes.items()], F.lit("other"))
    med = long.groupBy("recording_id", "channel", grp.alias("grp")).agg(F.median("z").alias("m"))
    best = F.max(F.struct(F.abs("m").alias("a"), F.col("channel"))).alias("b")
    return med.groupBy("recording_id", "grp").agg(F.median("m").alias("median"), best).select("recording_id", "grp", "median", F.col("b.channel").alias("top"))


def lane_gate(lanes: DataFrame, fits: DataFrame, healthy: float = 0.90) -> DataFrame:
    """lanes with shown and why: only those whose fit is known and good enough."""
    rows = lanes.join(fits, "recording_id", "left")
    why = F.when(F.col("ratio").isNull(), "no fit report").when(F.col("ratio") >= healthy, F.format_string("fit ratio %.2f is not below %.2f", "ratio", F.lit(healthy))).otherwise("ok")
    return rows.withColumns({"why": why, "shown": why == "ok"})


def clip_activity(frames: DataFrame) -> DataFrame:
    return frames.groupBy("file_index").agg(F.avg("is_audio_active").alias("active"), F.avg("joint_confidence").alias("confidence"), F.count("*").alias("n"))


def traces(windows: DataFrame, value: str) -> DataFrame:
    """By clip its series in order, rounded."""
    pairs = F.array_sort(F.collect_list(F.struct("window_id", F.round(value, 4).alias("v"))))
    return windows.groupBy("recording_id", "file_index").agg(F.transform(pairs, lambda p: p["v"]).alias("trace"))


def job_status(jobs: DataFrame, buckets: dict[str, str], other: str = "failed") -> DataFrame:
    known = F.create_map(*[F.lit(v) for kv in buckets.items() for v in kv])
    return jobs.groupBy("owner", F.coalesce(known[F.col("state")], F.lit(other)).alias("bucket")).agg(F.count("*").alias("n"))


def window_at(windows: DataFrame, t: Column) -> DataFrame:
    """By clip the first window that holds t, both ends included."""
    rows = windows.where((F.col("start_time_ms") <= t) & (t <= F.col("end_time_ms")))
    n = F.row_number().over(W.partitionBy("recording_id", "file_index").orderBy("start_time_ms"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def report_facts(windows: DataFrame, stats: DataFrame) -> DataFrame:
    """By recording: its baseline clip, clips, windows, and the channels that could not be calibrated, in order."""
    clips = windows.groupBy("recording_id").agg(F.min("file_index").alias("baseline"), F.countDistinct("file_index").alias("clips"), F.count("*").alias("windows"))
    bad = stats.where("std is null").groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("uncalibrated"))
    return clips.join(bad, "recording_id", "left").withColumn("uncalibrated", F.coalesce("uncalibrated", F.lit("")))


def frame_timeline(frames: DataFrame, faces: DataFrame, speech: DataFrame, tolerance: int = 50) -> DataFrame:
    """A row for each frame (file_index, t_ms): whether speech is near, and its faces as a list of rounded facts in order.

    faces: (file_index, t_ms, face_id, mar, score, yaw); frames without faces have an empty list.
    """
    from brolga.operators.diarize import near_spans

    near = near_spans(frames.select("file_index", F.col("t_ms").alias("t")), speech, ["file_index"], tolerance).select("file_index", F.col("t").alias("t_ms"), F.col("near").alias("vad"))
    one = F.struct("face_id", F.round("mar", 4).alias("mar"), F.round("score", 3).alias("det"), F.round("yaw", 1).alias("yaw"))
    lists = faces.groupBy("file_index", "t_ms").agg(F.array_sort(F.collect_list(one)).alias("faces"))
    none = F.array().cast(lists.schema["faces"].dataType)
    return near.join(lists, ["file_index", "t_ms"], "left").withColumn("faces", F.coalesce("faces", none))

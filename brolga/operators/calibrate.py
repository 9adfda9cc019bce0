"""Baseline statistics, calibrated windows and recordings on one clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import nearest, percentile_rank
from brolga.functions.intervals import as_of


class CalibrationError(ValueError):
    """There is no baseline to calibrate against."""


#: Digits to which magnitudes are compared: sums of the same values in another order differ beyond them.
COMPARED = 6

#: A deviation up to this part of the mean (of 1, if that is less) is rounding.
VARIES = 1e-12

#: Columns of a window table that are never features.
METADATA = ("recording_id", "file_index", "clip_window_id", "window_id", "start_time_ms", "end_time_ms", "frame_count", "cumulative_confidence", "blink_count", "emotion_label_mode", "context_phase", "question_id", "phase_elapsed_ms", "deviation_magnitude", "deviation_percentile", "target_ground_truth")


def feature_columns(windows: DataFrame) -> list[str]:
    """Numeric columns that are not metadata."""
    return [c for c, t in windows.dtypes if c not in METADATA and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]


def fit_baseline(windows: DataFrame, channels: list[str]) -> DataFrame:
    """(recording_id, channel, mean, std, n) over the windows of each recording's baseline clip: its lowest file_index.

    Sample deviation; one of 0 is no deviation (null).
    """
    first = F.min("file_index").over(W.partitionBy("recording_id"))
    base = windows.withColumn("_first", first).where("file_index = _first")
    rows = base.unpivot(["recording_id"], channels, "channel", "value")
    return rows.groupBy("recording_id", "channel").agg(F.avg("value").alias("mean"), F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n"))


def check_baseline(windows: DataFrame, stats: DataFrame) -> None:
    """Raises CalibrationError for a recording whose baseline clip has under two windows or no channel with values."""
    first = F.min("file_index").over(W.partitionBy("recording_id"))
    sizes = windows.withColumn("_first", first).where("file_index = _first").groupBy("recording_id").count()
    means = stats.groupBy("recording_id").agg(F.count("mean").alias("means"))
    bad = sizes.join(means, "recording_id", "left").where((F.col("count") < 2) | (F.coalesce("means", F.lit(0)) == 0)).orderBy("recording_id").first()
    if bad:
        raise CalibrationError(f"recording {bad.recording_id}: its baseline has {bad['count']} windows and {bad.means or 0} channels with values")
    if windows.isEmpty():
        raise CalibrationError("no windows")


def apply_baseline(windows: DataFrame, stats: DataFrame, channels: list[str]) -> DataFrame:
    """windows with channels as (x - mean) / std and deviation_magnitude, the root of the sum of their squares.

    A channel without mean or deviation stays as it is and out of the magnitude; a window without values has magnitude 0.
    Statistics are a row for each recording, joined with its windows.
    """
    by = stats.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std")))).alias("_stats"))
    rows = windows.join(by, "recording_id", "left")
    fitted, size = {}, F.lit(0.0)
    for c in channels:
        s = F.col("_stats")[c]
        usable = s["mean"].isNotNull() & s["std"].isNotNull()
        z = (F.col(c) - s["mean"]) / s["std"]
        fitted[c] = F.when(usable, z).otherwise(F.col(c).cast("double"))
        size = size + F.coalesce(F.when(usable, z * z), F.lit(0.0))
    return rows.withColumns({**fitted, "deviation_magnitude": F.sqrt(size)}).drop("_stats")


def assemble(calibrated: DataFrame, offsets: DataFrame) -> DataFrame:
    """Clips of a recording on one clock, windows renumbered, deviation percentile over the recording; magnitudes that are equal
    to six digits tie.

    offsets: (recording_id, file_index, file_offset_ms).
    """
    rows = calibrated.join(offsets, ["recording_id", "file_index"]).withColumnRenamed("window_id", "clip_window_id")
    rows = rows.withColumns({t: F.col(t) + F.col("file_offset_ms") for t in ("start_time_ms", "end_time_ms")}).drop("file_offset_ms")
    number = F.row_number().over(W.partitionBy("recording_id").orderBy("file_index", "start_time_ms", "clip_window_id")) - 1
    rank = percentile_rank(nearest(F.col("deviation_magnitude"), COMPARED), F.col("recording_id"))
    return rows.withColumns({"window_id": number, "deviation_percentile": rank})


def file_offsets(durations: DataFrame, by: str = "recording_id") -> DataFrame:
    """durations (by, file_index, duration_ms) with file_offset_ms: what all files before last together."""
    before = W.partitionBy(by).orderBy("file_index").rowsBetween(W.unboundedPreceding, -1)
    return durations.withColumn("file_offset_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)))


def self_calibrate(windows: DataFrame, channels: list[str], until: float = 30_000.0) -> DataFrame:
    """Calibration of a clip against its own start; a clip with under two windows there stays as it is, without magnitude.

    A channel that does not vary at the start, but for rounding, is null.
    """
    clip = W.partitionBy("recording_id", "file_index")
    early = F.col("start_time_ms") < until
    n = F.count(F.when(early, 1)).over(clip)
    out, size = {}, F.lit(0.0)
    for c in channels:
        v = F.when(early, F.col(c))
        mean, std = F.avg(v).over(clip), F.stddev_samp(v).over(clip)
        z = (F.col(c) - mean) / F.when(std > VARIES * F.greatest(F.abs(mean), F.lit(1.0)), std)
        out[c] = F.when(n < 2, F.col(c).cast("double")).otherwise(z)
        size = size + F.coalesce(z * z, F.lit(0.0))
    return windows.withColumns({**out, "deviation_magnitude": F.when(n >= 2, F.sqrt(size))})


def deviation_ratio(windows: DataFrame, until: float = 30_000.0) -> DataFrame:
    """Mean deviation of a clip after its baseline period over that within."""
    early = F.col("start_time_ms") < until
    mean = lambda x: F.avg(F.when(x, F.col("deviation_magnitude")))
    return windows.groupBy("recording_id", "file_index").agg(mean(early).alias("baseline"), mean(~early).alias("test")).withColumn("ratio", F.try_divide("test", "baseline"))


def baseline_index(path: Column, default: int = 0) -> Column:
    """The clip number at the end of a window file's name."""
    return F.coalesce(F.regexp_extract(path, r"_(\d{3})_windowed_features\.csv$", 1).try_cast("int"), F.lit(default))


def label_midpoints(windows: DataFrame, phases: DataFrame, on: list[str], width: float = 60_000.0) -> DataFrame:
    """windows (on, window_id, start_time_ms, end_time_ms) with target_ground_truth: the label of the phase (on, start_ms,
    end_ms, label) that starts latest at or before their middle, 'unlabeled' if that one has ended, or none has begun."""
    middle = (F.col("start_time_ms") + F.col("end_time_ms")) / 2
    told = as_of(windows.withColumn("_middle", middle), phases.select(*on, "start_ms", "end_ms", F.col("label").alias("_label")), on, "_middle", ["_label"], width)
    return told.select(*windows.columns, F.coalesce("_label", F.lit("unlabeled")).alias("target_ground_truth"))


def usable_clips(windows: DataFrame) -> DataFrame:
    """windows without the clips that have none with features (active_ratio is null in all of them): these are skipped."""
    some = windows.where("active_ratio is not null").select("recording_id", "file_index").distinct()
    return windows.join(some, ["recording_id", "file_index"], "left_semi")


def recording_job(frames: DataFrame, sliding=None, channels: list[str] | None = None, guard: bool = False) -> DataFrame:
    """From frames to the calibrated recording table: windows, baseline, deviation, one clock, percentile.

    guard skips clips without a window of features and raises CalibrationError if a recording's baseline does not do.
    """
    from brolga.operators.windows import Sliding, window_table

    sliding = sliding or Sliding()
    windows = window_table(frames, sliding)
    if guard:
        windows = usable_clips(windows)
    channels = channels or [f"{c}_mean" for c in sliding.channels]
    windows = windows.select("recording_id", "file_index", "window_id", "start_time_ms", "end_time_ms", "frame_count", "cumulative_confidence", "emotion_label_mode", *channels)
    stats = fit_baseline(windows, channels)
    if guard:
        check_baseline(windows, stats)
    calibrated = apply_baseline(windows, stats, channels)
    last = frames.groupBy("recording_id", "file_index").agg(F.max("timestamp").alias("duration_ms"))
    return assemble(calibrated, file_offsets(last))

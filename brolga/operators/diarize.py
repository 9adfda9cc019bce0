"""Speaker intervals: from probabilities and similarity scores to clean segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import cosine, island
from brolga.functions.intervals import merge_spans, overlap, overlap_join
from brolga.functions.prefix import last_before
from brolga.functions.vectors import cosine_spread, moments, unit, vector_sums

BLOCK = 1000


def speech_segments(probs: DataFrame, step: int = 512, rate: int = 16_000, least: float = 0.5, min_speech: int = 250, min_silence: int = 100, pad: int = 30) -> DataFrame:
    """Speech (file_index, start_ms, end_ms) from probabilities (file_index, idx, prob) of steps of audio.

    In this order: steps at the threshold form runs; runs closer than min_silence join; shorter ones than min_speech go;
    both ends move out by pad, not beyond the file; what then touches joins.
    """
    ms = lambda i: F.floor(i * step * 1000 / rate).cast("long")
    last = probs.groupBy("file_index").agg(ms(F.max("idx") + 1).alias("audio_ms"))
    on = probs.where(F.col("prob") >= least)
    on = on.withColumn("run", F.col("idx") - F.row_number().over(W.partitionBy("file_index").orderBy("idx")))
    runs = on.groupBy("file_index", "run").agg(ms(F.min("idx")).alias("start_ms"), ms(F.max("idx") + 1).alias("end_ms"))
    joined = merge_spans(runs.drop("run"), ["file_index"], float(min_silence), strict=True).where(F.col("end_ms") - F.col("start_ms") >= min_speech)
    padded = joined.join(last, "file_index").select(
        "file_index", F.greatest(F.lit(0), F.col("start_ms") - pad).alias("start_ms"), F.least("audio_ms", F.col("end_ms") + pad).alias("end_ms")
    )
    return merge_spans(padded, ["file_index"]).drop("n_merged")


def to_ms(samples: Column, rate: int = 16_000) -> Column:
    return F.floor(samples * 1000 / rate).cast("long")


def window_plan(durations: DataFrame, size: int = 5000, hop: int = 1000) -> DataFrame:
    """Whole spans of a file (duration_ms); one for a shorter file, none for an empty one."""
    n = F.floor((F.col("duration_ms") - size) / hop)
    starts = F.when(F.col("duration_ms") < size, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda k: k * hop))
    rows = durations.where("duration_ms > 0").select("file_index", "duration_ms", F.explode(starts).alias("start_ms"))
    return rows.select("file_index", "start_ms", F.least(F.col("start_ms") + size, F.col("duration_ms")).alias("end_ms"))


def coverage(spans: DataFrame, other: DataFrame, on: list[str], width: float = 5000.0) -> DataFrame:
    """spans (start_ms, end_ms) with covered_ms: how much of them the other spans overlap."""
    b = other.select(*on, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(spans.select(*on, "start_ms", "end_ms").distinct(), b, on, width)
    total = met.groupBy(*on, "start_ms", "end_ms").agg(F.sum(overlap(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))).alias("covered_ms"))
    return spans.join(total.hint("merge"), [*on, "start_ms", "end_ms"], "left").na.fill(0, ["covered_ms"])


def near_spans(points: DataFrame, spans: DataFrame, on: list[str], tolerance: int = 50) -> DataFrame:
    """points (on, t) with near: whether a span, widened by the tolerance at both closed ends, contains t."""
    wide = spans.select(*on, (F.col("start_ms") - tolerance).alias("start_ms"), (F.col("end_ms") + tolerance + 1).alias("end_ms"))
    cut = wide.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_ms") / 1000), F.floor((F.col("end_ms") - 1) / 1000))))
    hit = points.select(*on, "t").distinct().withColumn("_cell", F.floor(F.col("t") / 1000)).join(cut, [*on, "_cell"])
    hit = hit.where((F.col("t") >= F.col("start_ms")) & (F.col("t") <= F.col("end_ms") - 1)).select(*on, "t").distinct().withColumn("near", F.lit(True))
    return points.join(hit, [*on, "t"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def split_by_speech(spans: DataFrame, speech: DataFrame, least: float = 0.2) -> DataFrame:
    """spans with scored: whether speech covers that share of them."""
    rows = coverage(spans, speech, ["file_index"])
    return rows.withColumn("scored", F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms")) >= least)


def similarity(rows: DataFrame, vector: str, target: DataFrame, other: DataFrame) -> DataFrame:
    """rows with s_target and s_interviewer: cosines to two single vectors (one row, column profile, each)."""
    a, b = target.select(F.col("profile").alias("_t")), other.select(F.col("profile").alias("_o"))
    rows = rows.crossJoin(F.broadcast(a.limit(1))).crossJoin(F.broadcast(b.limit(1)))
    return rows.withColumns({"s_target": cosine(F.col(vector), F.col("_t")), "s_interviewer": cosine(F.col(vector), F.col("_o"))}).drop("_t", "_o")


def weighted_profile(pool: DataFrame, by: list[str], vector: str = "vector", weight: str | None = "duration_ms") -> DataFrame:
    """(by, profile): the weighted mean vector, of length 1. Null vectors take no part."""
    sums = vector_sums(pool, by, vector, F.col(weight) if weight else None)
    return sums.select(*by, unit(F.col("total")).alias("profile"))


def leave_one_out(pool: DataFrame, by: list[str], vector: str = "vector", weight: str = "duration_ms") -> DataFrame:
    """pool with loo: the cosine of each vector to the weighted mean of its group's others; no row for a group of one.

    The mean of the others is the group's total less the vector, so work grows with the vectors, not their pairs.
    """
    total = vector_sums(pool, by, vector, F.col(weight)).where("n > 1").select(*by, F.col("total").alias("_total"))
    rest = F.zip_with(F.col("_total"), F.col(vector), lambda s, x: s - F.col(weight) * x)
    return pool.join(total, by).withColumn("loo", cosine(F.col(vector), rest)).drop("_total")


def thresholds(genuine: DataFrame, impostor: DataFrame, anti: bool = True) -> DataFrame:
    """One row: theta_high, theta_med, how they came about, and overlapping. Both tables have a column s.

    Under ten genuine scores the fallback of 0.60 and 0.40. Else the genuine scores' lower decile or, if that is more, the
    best impostor and 0.05, and 0.55 without an impostor profile or scores; held within 0.45 and 0.75, overlapping where it
    was above. theta_med is 0.15 below, 0.30 at least.
    """
    g = genuine.agg(F.count("s").alias("n"), F.percentile("s", 0.1).alias("q10"))
    rows = g.crossJoin(F.broadcast(impostor.agg(F.max("s").alias("worst"))))
    few, apart = F.col("n") < 10, F.col("worst").isNotNull() if anti else F.lit(False)
    raw = F.when(few, None).otherwise(F.greatest("q10", F.when(apart, F.col("worst") + 0.05).otherwise(0.55)))
    rows = rows.withColumn("_raw", raw).withColumn("theta_high", F.when(few, 0.60).otherwise(F.least(F.greatest("_raw", F.lit(0.45)), F.lit(0.75))))
    return rows.withColumns(
        {
            "theta_med": F.when(few, 0.40).otherwise(F.greatest(F.col("theta_high") - 0.15, F.lit(0.30))),
            "calibration": F.when(few, "FALLBACK_DEFAULTS").when(apart, "DERIVED").otherwise("DERIVED_NO_ANTI"),
            "overlapping": F.coalesce(F.col("_raw") > 0.75, F.lit(False)),
        }
    ).drop("_raw")


def blocks(scores: DataFrame, durations: DataFrame) -> DataFrame:
    """Whole seconds of each file with the medians of the scores of the windows (start_ms, end_ms) that cover them, or nulls."""
    spine = durations.where(f"duration_ms >= {BLOCK}").select("file_index", F.explode(F.sequence(F.lit(0).cast("long"), (F.floor(F.col("duration_ms") / BLOCK) - 1).cast("long"))).alias("block"))
    first, last = F.ceil(F.col("start_ms") / BLOCK), F.floor(F.col("end_ms") / BLOCK) - 1
    rows = scores.where(first <= last).withColumn("block", F.explode(F.sequence(first, last)))
    med = rows.groupBy("file_index", "block").agg(F.median("s_target").alias("s_target"), F.median("s_interviewer").alias("s_interviewer"))
    return spine.join(med.hint("merge"), ["file_index", "block"], "left")


def tiers(rows: DataFrame, high: Column, med: Column, floor: float = 0.20, margin: float = 0.15, anti: bool = True) -> DataFrame:
    """rows with tier and margin_failed by their two scores. With a profile of the other voice (anti), a block over the bound
    is HIGH only if that one's score is known and lower by the margin; without, always."""
    t, o = F.col("s_target"), F.col("s_interviewer")
    apart = F.coalesce(t - o > margin, F.lit(False)) if anti else F.lit(True)
    tier = F.when(t.isNull(), "SKIPPED").when(t > high, F.when(apart, "HIGH").otherwise("MEDIUM")).when(t > med, "MEDIUM").when(t >= floor, "SUB").otherwise("REJECT")
    return rows.withColumns({"tier": tier, "margin_failed": F.coalesce((t > high) & ~apart, F.lit(False))})


def high_runs(rows: DataFrame) -> DataFrame:
    """Longest stretches of neighbouring HIGH blocks: (file_index, run, first_block, last_block, n)."""
    on = rows.where("tier = 'HIGH'").withColumn("run", F.col("block") - F.row_number().over(W.partitionBy("file_index").orderBy("block")))
    return on.groupBy("file_index", "run").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.count("*").alias("n"))


#: Fine spans at the edges of a run: their length, the step between them, how far they reach, the least length at a file's end.
FINE, FINE_STEP, FINE_REACH, FINE_LEAST = 2000, 250, 2000, 1000


def fine_plan(runs: DataFrame, durations: DataFrame) -> DataFrame:
    """Spans (file_index, run, lead, p, start_ms, end_ms) to score inwards of the edges of runs: behind a position p at the
    leading edge, before it at the trailing one, cut to the file (durations); those cut too short are left out."""
    at = F.transform(F.sequence(F.lit(0), F.lit(FINE_REACH // FINE_STEP)), lambda k: k * FINE_STEP)
    rows = runs.join(durations, "file_index").withColumn("_k", F.explode(at))
    lead = rows.withColumns({"lead": F.lit(True), "p": F.col("first_block") * BLOCK + F.col("_k")})
    tail = rows.withColumns({"lead": F.lit(False), "p": (F.col("last_block") + 1) * BLOCK - F.col("_k")})
    both = lead.unionByName(tail).withColumns(
        {
            "start_ms": F.greatest(F.lit(0), F.when(F.col("lead"), F.col("p")).otherwise(F.col("p") - FINE)),
            "end_ms": F.least("duration_ms", F.when(F.col("lead"), F.col("p") + FINE).otherwise(F.col("p"))),
        }
    )
    return both.where(F.col("end_ms") - F.col("start_ms") >= FINE_LEAST).select("file_index", "run", "lead", "p", "start_ms", "end_ms")


def edge_trim(runs: DataFrame, durations: DataFrame, fine: DataFrame, high: float, margin: float = 0.15, anti: bool = True, most: int = 750) -> DataFrame:
    """runs with start_ms and end_ms refined by fine scores (file_index, start_ms, end_ms, s_target, s_interviewer) of fine_plan.

    The start moves to the first position whose span passes: over `high` and, with a profile of the other voice and a score
    for it, apart by the margin. Beyond `most` ms or without any, the first block is given up (lead_demoted). The end moves
    likewise, but keeps its block where giving it up would leave nothing. A run without length is gone.
    """
    spans = runs.withColumns({"_s": F.col("first_block") * BLOCK, "_e": (F.col("last_block") + 1) * BLOCK})
    passes = F.col("s_target") > high
    if anti:
        passes = passes & (F.col("s_interviewer").isNull() | (F.col("s_target") - F.col("s_interviewer") > margin))
    met = fine_plan(runs, durations).join(fine, ["file_index", "start_ms", "end_ms"]).where(passes)
    found = met.groupBy("file_index", "run").agg(F.min(F.when(F.col("lead"), F.col("p"))).alias("_first"), F.max(F.when(~F.col("lead"), F.col("p"))).alias("_last"))
    rows = spans.join(found, ["file_index", "run"], "left")
    lead, tail = F.coalesce(F.col("_first") - F.col("_s") > most, F.lit(True)), F.coalesce(F.col("_e") - F.col("_last") > most, F.lit(True))
    rows = rows.withColumns({"lead_demoted": lead, "start_ms": F.when(lead, F.col("_s") + BLOCK).otherwise(F.col("_first"))})
    rows = rows.withColumn("tail_demoted", tail & (F.col("_e") - BLOCK > F.col("start_ms")))
    end = F.when(F.col("tail_demoted"), F.col("_e") - BLOCK).when(tail, F.col("_e")).otherwise(F.col("_last"))
    return rows.withColumn("end_ms", end).where("start_ms < _e and end_ms > start_ms").drop("_s", "_e", "_first", "_last")


def run_blocks(runs: DataFrame) -> DataFrame:
    """A row for each block of a run (start_ms, end_ms), cut to the run."""
    last = F.ceil(F.col("end_ms") / BLOCK) - 1
    rows = runs.select("file_index", "run", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / BLOCK), last)).alias("block"))
    return rows.select(
        "file_index", "run", "block", F.greatest(F.col("block") * BLOCK, F.col("start_ms")).alias("start_ms"), F.least((F.col("block") + 1) * BLOCK, F.col("end_ms")).alias("end_ms")
    )


def activity(rows: DataFrame, speech: DataFrame) -> DataFrame:
    """By file: HIGH time over speech time, its level, and the speech of nobody."""
    high = rows.groupBy("file_index").agg((F.count(F.when(F.col("tier") == "HIGH", 1)) * BLOCK).alias("high_ms"))
    said = speech.groupBy("file_index").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    ratio = F.try_divide(F.col("high_ms"), F.col("speech_ms"))
    level = F.when(ratio.isNull(), "NO_SPEECH").when(ratio > 0.25, "NORMAL").when(ratio >= 0.10, "LOW").otherwise("VERY_LOW")
    out = high.join(said, "file_index", "left").na.fill(0, ["speech_ms"])
    return out.select("file_index", "high_ms", "speech_ms", ratio.alias("ratio"), level.alias("level"), F.greatest(F.lit(0), F.col("speech_ms") - F.col("high_ms")).alias("unattributed_ms"))


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_index").pivot("tier", ["HIGH", "MEDIUM", "SUB", "REJECT", "SKIPPED"]).count().na.fill(0)


def drift(rows: DataFrame, first_ms: int = 30_000, least: float = 0.10) -> DataFrame:
    """By file the mean score of its first HIGH time, against the mean over all HIGH blocks of the last file before that had
    any; drifted if it has fallen by more than `least`."""
    high = rows.where("tier = 'HIGH'")
    before = (F.row_number().over(W.partitionBy("file_index").orderBy("block")) - 1) * BLOCK
    means = high.withColumn("_b", before).groupBy("file_index").agg(F.avg(F.when(F.col("_b") < first_ms, F.col("s_target"))).alias("mean"), F.avg("s_target").alias("_all"))
    files = rows.select("file_index").distinct().join(means, "file_index", "left")
    out = last_before(files, "file_index", "_all", "previous").drop("_all")
    return out.withColumn("drifted", F.coalesce(F.col("previous") - F.col("mean") > least, F.lit(False)))


def contaminated(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows (file_index, start_ms, end_ms) with hits: how many overlap regions touch them; any voids the block."""
    b = regions.select("file_index", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(rows.select("file_index", "start_ms", "end_ms").distinct(), b, ["file_index"])
    n = met.groupBy("file_index", "start_ms", "end_ms").agg(F.count("*").alias("hits"))
    return rows.join(n.hint("merge"), ["file_index", "start_ms", "end_ms"], "left").na.fill(0, ["hits"])


def clean_subsegments(rows: DataFrame) -> DataFrame:
    """Clean blocks of a run that touch become one: (file_index, run, start_ms, end_ms, n_merged)."""
    return merge_spans(rows.where("hits = 0").select("file_index", "run", "start_ms", "end_ms"), ["file_index", "run"])


def bridge(sub: DataFrame, regions: DataFrame, block_map: DataFrame, gap_ms: int = 400) -> DataFrame:
    """Sub-segments of a file joined over short gaps: (file_index, segment, start_ms, end_ms, blocks, bridged).

    A gap stays if it is gap_ms or more, touches an overlap region, or a block in it speaks for the interviewer: MEDIUM by a
    failed margin, or a score no lower than the target's.
    """
    order = W.partitionBy("file_index").orderBy("start_ms", "end_ms")
    rows = sub.withColumn("g_start", F.lag("end_ms").over(order)).withColumn("g_end", F.col("start_ms"))
    gaps = rows.where("g_start is not null and g_end > g_start").select("file_index", F.col("g_start").alias("start_ms"), F.col("g_end").alias("end_ms"))
    gaps = gaps.where(F.col("end_ms") - F.col("start_ms") < gap_ms)
    hit = contaminated(gaps, regions).where("hits > 0").select("file_index", F.col("end_ms").alias("g_end"))
    speaks = F.coalesce((F.col("tier") == "MEDIUM") & F.col("margin_failed"), F.lit(False)) | F.coalesce(F.col("s_interviewer") >= F.col("s_target"), F.lit(False))
    theirs = block_map.where(speaks).select("file_index", (F.col("block") * BLOCK).alias("start_ms"), ((F.col("block") + 1) * BLOCK).alias("end_ms"))
    held = contaminated(gaps, theirs).where("hits > 0").select("file_index", F.col("end_ms").alias("g_end"))
    stops = hit.union(held).distinct().withColumn("stop", F.lit(True))
    rows = rows.join(stops.hint("merge"), ["file_index", "g_end"], "left")
    joins = F.coalesce(F.col("g_start").isNotNull() & (F.col("g_end") - F.col("g_start") < gap_ms) & F.col("stop").isNull(), F.lit(False))
    rows = rows.withColumn("joins", joins).withColumn("segment", island(~F.col("joins"), order))
    return rows.groupBy("file_index", "segment").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_merged").alias("blocks"), F.count(F.when(F.col("joins"), 1)).alias("bridged")
    )


def file_totals(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """By file: clean time, segments, contaminated blocks and bridges."""
    a = segments.groupBy("file_index").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("clean_ms"), F.count("*").alias("segments"), F.sum("bridged").alias("bridged"))
    b = rows.groupBy("file_index").agg(F.count(F.when(F.col("hits") > 0, 1)).alias("contaminated"))
    return b.join(a, "file_index", "left").na.fill(0)


def to_clip_clock(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    rows = segments.join(offsets, "file_index")
    start = F.greatest(F.lit(0), F.col("start_ms") - F.col("file_offset_ms"))
    return rows.select("file_index", start.alias("start_ms"), F.greatest(start, F.col("end_ms") - F.col("file_offset_ms")).alias("end_ms"))


def stem(path: Column) -> Column:
    """The lower-case stem of a file name without its processing suffixes."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(name), "(_canonical|_hubert|_16k)+$", "")


def clip_pairs(files: DataFrame) -> DataFrame:
    """By clip, which of its two containers are missing. files: (file_index, ext)."""
    has = lambda e: F.max(F.when(F.lower("ext") == e, 1).otherwise(0))
    out = files.groupBy("file_index").agg(has("mp4").alias("mp4"), has("wav").alias("wav"))
    return out.withColumn("missing", F.concat_ws(",", F.when(F.col("mp4") == 0, "mp4"), F.when(F.col("wav") == 0, "wav")))


def container_facts(probes: DataFrame) -> DataFrame:
    """From probe JSON (file_index, probe): start in whole ms (half to even), whether it is missing, whether the frame rate varies."""
    info = F.from_json("probe", "start_time string, r_frame_rate string, avg_frame_rate string")
    rows = probes.select("file_index", info.alias("i"))
    num = lambda c, k: F.split(F.col(f"i.{c}"), "/")[k].try_cast("long")
    varies = num("r_frame_rate", 0) * num("avg_frame_rate", 1) != num("avg_frame_rate", 0) * num("r_frame_rate", 1)
    start = F.col("i.start_time").try_cast("decimal(20,6)")
    return rows.select("file_index", F.bround(start * 1000, 0).cast("long").alias("start_ms"), start.isNull().alias("start_missing"), F.coalesce(varies, F.lit(False)).alias("variable_rate"))


def stitch(rows: DataFrame, chunks: DataFrame, halo: int = 1000) -> DataFrame:
    """rows (file_index, chunk, center_ms) of overlapping chunks, each kept from the one chunk in whose core it lies."""
    edge = W.partitionBy("file_index")
    core = chunks.withColumns(
        {
            "core_start": F.when(F.col("chunk") == 0, F.lit(float("-inf"))).otherwise(F.col("start_ms") + halo),
            "core_end": F.when(F.col("chunk") == F.max("chunk").over(edge), F.lit(float("inf"))).otherwise(F.col("end_ms") - halo),
        }
    ).select("file_index", "chunk", "core_start", "core_end")
    return rows.join(core, ["file_index", "chunk"]).where("center_ms >= core_start and center_ms < core_end").drop("core_start", "core_end")


def pair_variance(pool: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Population variance of the cosines of all pairs of a group's vectors, without forming a pair: from sums of unit vectors
    and of their outer products. Vectors without length take no part."""
    out = moments(pool, by, vector).where("n > 1")
    mean, variance = cosine_spread(F.col("n"), F.col("s"), F.col("m"))
    return out.select(*by, "n", mean.alias("mean"), variance.alias("variance"))

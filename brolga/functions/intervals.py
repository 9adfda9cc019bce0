"""Half-open intervals [start, end): overlap joins, as-of lookups, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import island
from brolga.functions.ranks import same_keys


def cells(start: Column, end: Column, width: float) -> Column:
    """Numbers of the cells of `width` that [start, end) touches; of the one cell at start if it is empty."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.ceil(end / width) - 1))


def contain_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, width: float = 1000.0) -> DataFrame:
    """points inner-joined with the spans (start_ms, end_ms) that contain them, by equality on `on` and cells of time.

    A point lies in one cell and a span in those it touches, so each pair meets once and no side is compared as a whole.
    """
    cut = spans.withColumn("_cell", F.explode(cells(F.col("start_ms"), F.col("end_ms"), width)))
    rows = points.withColumn("_cell", F.floor(F.col(at) / width))
    return rows.hint("merge").join(cut.hint("merge"), [*on, "_cell"]).where((F.col(at) >= F.col("start_ms")) & (F.col(at) < F.col("end_ms"))).drop("_cell")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: float = 1000.0) -> DataFrame:
    """Pairs of left spans (start_ms, end_ms) and right ones (r_start, r_end) that overlap, each once: in the cell of the later start.

    Spark takes its rows for as many as there are spans before they are cut, so a size at which it would send one side to all
    tasks through the driver says little; it sorts both instead.
    """
    a = left.withColumn("_cell", F.explode(cells(F.col("start_ms"), F.col("end_ms"), width)))
    b = right.withColumn("_cell", F.explode(cells(F.col("r_start"), F.col("r_end"), width)))
    met = a.hint("merge").join(b.hint("merge"), [*on, "_cell"]).where((F.col("start_ms") < F.col("r_end")) & (F.col("r_start") < F.col("end_ms")))
    return met.where(F.col("_cell") == F.floor(F.greatest("start_ms", "r_start") / width)).drop("_cell")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def as_of(points: DataFrame, spans: DataFrame, on: list[str], at: str, fields: list[str], width: float = 60_000.0) -> DataFrame:
    """points with the fields of the span that starts latest at or before them, if it has not ended; else nulls.

    Only the latest start counts: an older span that still runs is not looked at. Among equal starts the one that ends
    last counts. A point without a time has no span; nulls in `on` are a group.

    Both are cut into stretches of `width`, each sorted by itself; a row for each stretch of a group hands its last span on to
    the later ones. So one group may hold all rows; only what falls within `width` of a group meets in a task.
    """
    keep = [c for c in points.columns if c not in on]
    kind = spans.select(F.struct("start_ms", "end_ms", *fields).alias("x")).schema["x"].dataType
    left = points.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*keep).alias("_row"), F.lit(None).cast(kind).alias("_span"))
    right = spans.where("start_ms is not null").select(*on, F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.struct("start_ms", "end_ms", *fields).alias("_span"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_stretch", F.floor(F.col("_t") / width))
    cut = [*on, "_stretch"]
    ends = both.groupBy(*cut).agg(F.max_by("_span", F.when(F.col("_kind") == 0, F.struct("_t", "_span.end_ms"))).alias("_end"))
    past = W.partitionBy(*on).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*cut, F.last("_end", ignorenulls=True).over(past).alias("_past"))
    order = W.partitionBy(*cut).orderBy("_t", "_kind", F.col("_span.end_ms")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_span", ignorenulls=True).over(order)).where("_kind = 1")
    found = same_keys(found, ends, cut).withColumn("_last", F.coalesce("_last", "_past"))
    inside = F.col("_t") < F.col("_last.end_ms")
    return found.select(*on, "_row.*", *[F.when(inside, F.col(f"_last.{f}")).alias(f) for f in fields], F.when(inside, F.col("_t") - F.col("_last.start_ms")).alias("elapsed_ms"))


def merge_spans(spans: DataFrame, on: list[str], gap: Column | float = 0.0, strict: bool = False) -> DataFrame:
    """Spans (start_ms, end_ms) joined where the next starts no later than the end so far plus gap (strict: earlier)."""
    order = W.partitionBy(*on).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1)) + gap
    apart = F.col("start_ms") >= reach if strict else F.col("start_ms") > reach
    rows = spans.where("end_ms > start_ms").withColumn("_new", F.coalesce(apart, F.lit(True)))
    rows = rows.withColumn("_run", island(F.col("_new"), order))
    return rows.groupBy(*on, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_merged")).drop("_run")

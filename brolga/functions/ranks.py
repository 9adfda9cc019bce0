"""Ranks, rank statistics and exact quantiles of groups of any size: no task has to sort a whole group.

Equal values are counted first. Different ones are cut into cells, about a thousand to the range of a group and a thousand to
each doubling of a value; each cell is sorted by itself, and a row for each cell tells what lies below it. Values that crowd in
a thousandth of both share a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 1024


def same_keys(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, where nulls are equal too; the keys are left's."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & left[c].eqNullSafe(right[f"_r_{c}"])
    return left.join(right, met, how).drop(*[f"_r_{c}" for c in on])


def _cell(v: Column, low: Column, high: Column) -> list[Column]:
    """Two numbers that never fall while v rises: the place in the range, and the power of two."""
    bounded = lambda x: F.floor(F.least(F.greatest(F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(-3e6)), F.lit(3e6)))
    place = bounded(F.try_divide(v - low, high - low) * CELLS)
    power = bounded(F.log2(F.abs(v)) * CELLS) + 2 * 1024 * CELLS
    return [place.alias("_place"), F.when(v > 0, power).when(v < 0, -power).otherwise(0).cast("long").alias("_power")]


def _cells(rows: DataFrame, by: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).withColumn(value, v)
    each = known.groupBy(*by, value).agg(*[c.alias(n) for n, c in counts.items()])
    ends = each.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), *[F.sum(n).alias(f"{n}_total") for n in counts])
    # always true, but it reads the totals: so every use of the counts reads the same columns and Spark works them out once
    ends = ends.where(F.coalesce(*[F.col(f"{n}_total").cast("double") for n in counts], F.col("_low")).isNotNull())
    return same_keys(each, ends, by).select(*each.columns, *[f"{n}_total" for n in counts], *_cell(F.col(value), F.col("_low"), F.col("_high")))


def cumulated(rows: DataFrame, by: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """(by, value, counts, <count>_before, <count>_total): a row for each different value, with sums over all smaller ones of its
    group, and over all of it.

    Null and NaN are no values. counts are aggregates by name, sums or counts.
    """
    each = _cells(rows, by, value, counts)
    keys = [*by, "_place", "_power"]
    inside = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy(*by).orderBy("_place", "_power").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    cells = each.groupBy(*keys).agg(*[F.sum(n).alias(f"_sum_{n}") for n in counts])
    cells = cells.select(*keys, *[zero(F.sum(f"_sum_{n}").over(below)).alias(f"_below_{n}") for n in counts])
    out = same_keys(each.withColumns({f"_in_{n}": zero(F.sum(n).over(inside)) for n in counts}), cells, keys)
    return out.select(*by, value, *counts, *[(F.col(f"_below_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in counts], *[f"{n}_total" for n in counts])


def average_ranks(rows: DataFrame, by: list[str], value: str, rank: str = "rank", size: str = "n") -> DataFrame:
    """rows with the rank of their value from 1 within the group, ties at their average, and the number of values there."""
    told = cumulated(rows, by, value, {"_c": F.count("*")}).withColumnRenamed(value, "_value")
    told = told.select(*by, "_value", (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(rank))
    sizes = rows.groupBy(*by).agg(F.count(F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), 1)).alias(size))
    sizes = sizes.where(F.col(size) > 0)
    return same_keys(same_keys(rows.withColumn("_value", F.col(value).cast("double")), told, [*by, "_value"], "left"), sizes, by, "left").drop("_value")


def pairs_won(rows: DataFrame, by: list[str], value: str, up: Column, down: Column) -> DataFrame:
    """(by, n_up, n_down, won): of all pairs of an up row and a down row, in how many the up row's value is larger, ties half."""
    each = _cells(rows, by, value, {"_up": F.count(F.when(up, 1)), "_down": F.count(F.when(down, 1))})
    keys = [*by, "_place", "_power"]
    inside = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy(*by).orderBy("_place", "_power").rowsBetween(W.unboundedPreceding, -1)
    less = lambda n, over: F.coalesce(F.sum(n).over(over), F.lit(0)).cast("double")
    each = each.withColumn("_won", F.col("_up") * (less("_down", inside) + F.col("_down") / 2))
    cells = each.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("_up", "_down", "_won")])
    cells = cells.withColumn("_won", F.col("_won") + F.col("_up") * less("_down", below))
    return cells.groupBy(*by).agg(F.sum("_up").alias("n_up"), F.sum("_down").alias("n_down"), F.sum("_won").alias("won"))


def quantiles(rows: DataFrame, by: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """(by, and for each name of parts that quantile): exact, between two values in proportion; no row without a value."""
    each = cumulated(rows, by, value, {"_c": F.count("*")})
    return each.groupBy(*by).agg(*[quantile(value, "_c", p).alias(n) for n, p in parts.items()])


def quantile(value: str, count: str, part: float) -> Column:
    """Aggregate over the rows of cumulated(): that quantile of the values by their `count`, between two in proportion."""
    n, before, total = F.col(count), F.col(f"{count}_before"), F.col(f"{count}_total")
    at = F.lit(float(part)) * (total - 1)
    holds = lambda k: F.when((n > 0) & (before <= k) & (k < before + n), F.col(value))
    low, high, rest = F.max(holds(F.floor(at))), F.max(holds(F.ceil(at))), F.max(at - F.floor(at))
    return F.when(rest > 0, low + rest * (high - low)).otherwise(low)

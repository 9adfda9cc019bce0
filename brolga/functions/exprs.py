"""Column expressions: confidence weighting, vectors, ranks. Missing values are nulls, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Below this weight a value is shrunk by it before maxima, minima and sums.
LOW_WEIGHT = 0.35


def missing(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def nearest(x: Column, digits: int) -> Column:
    """x to so many digits, as DuckDB has it: its multiple is rounded. Spark's round goes by the shortest decimal that tells x,
    so it takes another side where x is a half but for rounding."""
    return F.when(F.abs(x) < 1e290, F.round(x * 10.0**digits) / 10.0**digits).otherwise(x)


def regularised(v: Column, w: Column, low: float = LOW_WEIGHT) -> Column:
    """v, or v*w where the weight is low; null if either is missing."""
    return F.when(w < low, v * w).when(w.isNotNull(), v)


def weighted_mean(v: Column, w: Column) -> Column:
    """Aggregate: sum of w times the regularised value over the weights of the values present; null for hardly any weight."""
    r = regularised(v, w)
    total = F.sum(F.when(r.isNotNull(), w))
    return F.when(total >= 1e-9, F.sum(w * r) / total)


def weighted_max(v: Column, w: Column) -> Column:
    return F.max(regularised(v, w))


def weighted_min(v: Column, w: Column) -> Column:
    return F.min(regularised(v, w))


def weighted_var(v: Column, w: Column, mean: Column) -> Column:
    """Aggregate about a mean that is already known for each row; null for under two values."""
    r = regularised(v, w)
    total = F.sum(F.when(r.isNotNull(), w))
    return F.when((F.count(r) >= 2) & (total >= 1e-9), F.greatest(F.sum(w * (r - mean) * (r - mean)) / total, F.lit(0.0)))


def entropy(n: Column) -> Column:
    """Aggregate over the counts of a group's cells: entropy in bits."""
    total = F.sum(n)
    return F.when(total > 0, F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def average_rank(x: Column, *by: Column) -> Column:
    """Rank from 1 within the groups, ties at their average; nulls have none."""
    known = x.isNotNull()
    inside = W.partitionBy(*by, known)
    first = F.rank().over(inside.orderBy(x))
    return F.when(known, first + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2)


def percentile_rank(x: Column, *by: Column) -> Column:
    """Average rank over the number of values present."""
    return average_rank(x, *by) / F.count(x).over(W.partitionBy(*by))


def island(change: Column, over: WindowSpec) -> Column:
    """Number of changes so far: rows between two changes share it."""
    return F.sum(change.cast("int")).over(over.rowsBetween(W.unboundedPreceding, 0))

"""Running values over a whole table in the order of a whole-number key, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys of one stretch. Only a row for each stretch comes together.
WIDTH = 1024


def _stretches(rows: DataFrame, key: str, width: int) -> DataFrame:
    return rows.withColumn("_stretch", F.floor(F.col(key) / width))


def sum_before(rows: DataFrame, key: str, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """rows with, for each name of values, the sum of that column over all rows of smaller keys (0 for the first).

    Keys are summed first, so rows that share one have the same sum before them. Stretches of keys are summed apart, and
    each takes what all stretches before it hold together.
    """
    one = _stretches(rows.groupBy(key).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()]), key, width)
    whole = one.groupBy("_stretch").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
    past = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("_stretch", *[F.coalesce(F.sum(f"_{n}").over(past), F.lit(0)).alias(f"_past_{n}") for n in values])
    inside = W.partitionBy("_stretch").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    told = [(F.col(f"_past_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).alias(n) for n in values]
    return rows.join(one.join(whole, "_stretch").select(key, *told), key)


def last_before(rows: DataFrame, key: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """rows (one for each key) with, as name, the value of the largest smaller key that has one."""
    rows = _stretches(rows, key, width)
    ends = rows.groupBy("_stretch").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(key, value)))[value].alias("_end"))
    past = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("_stretch", F.last("_end", ignorenulls=True).over(past).alias("_past"))
    inside = W.partitionBy("_stretch").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_past"))
    return rows.join(ends, "_stretch").withColumn(name, found).drop("_stretch", "_past")

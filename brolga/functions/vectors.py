"""Sums and second moments of vectors by group: tasks add up their own rows, what is shuffled is a row for each group and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brolga.functions.exprs import norm

#: Bytes of moments that a task hands on at once.
TOGETHER = 1 << 23


def vector_sums(rows: DataFrame, by: list[str], vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """(by, n, weight, total): rows, their weights (1 each) and the weighted sum of their vectors, as doubles.

    Null vectors take no part. Vectors of a group must be equally long, or Spark raises; a group whose weights are all zero has
    a sum of zeros.
    """
    w = (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w")
    known = rows.where(F.col(vector).isNotNull()).select(*by, w, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    told = known.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_w").alias("weight"), Summarizer.metrics("sum").summary(F.col("_v"), F.col("_w")).alias("_s"))
    return told.select(*by, "n", "weight", vector_to_array(F.col("_s.sum")).alias("total"))


def unit(v: Column) -> Column:
    """v at length 1, or as it is without length."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _by_group(rows: DataFrame, by: list[str], vector: str, summed) -> DataFrame:
    """(by, n, _t): for each group the sums of what `summed` makes of its vectors, stacked by length in each batch of rows."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    names = [f"_{k}" for k in range(len(by))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, groups = batch.column(len(by)).to_pylist(), None
            if by:
                keys = pa.table([batch.column(k) for k in range(len(by))], names=names).append_column("_n", pa.array(range(batch.num_rows)))
                groups = keys.group_by(names).aggregate([("_n", "list")])
            held, size = [], 0

            def put() -> pa.RecordBatch:
                at = pa.array([g for g, _ in held])
                cols = [groups.column(n).take(at).combine_chunks() for n in names]
                return pa.RecordBatch.from_arrays([*cols, pa.array([x for _, x in held], pa.list_(pa.float64()))], [*by, "_m"])

            for g, which in enumerate(groups.column("_n_list").to_pylist() if by else [range(len(lists))]):
                known = [np.asarray(v, float) for v in (lists[k] for k in which) if v is not None and None not in v]
                for length in sorted({len(v) for v in known}):
                    own = summed(np.stack([v for v in known if len(v) == length]))
                    if own is not None:
                        held.append((g, own))
                        size += own.nbytes
                if size > TOGETHER:
                    yield put()
                    held, size = [], 0
            if held:
                yield put()

    parts = rows.select(*by, vector).mapInArrow(run, f"{kinds + ', ' if by else ''}_m array<double>")
    # the summarizer keeps means, so a count of many parts comes back a hair below or above the whole number
    return vector_sums(parts, by, "_m").select(*by, F.rint(F.get("total", F.lit(0))).cast("long").alias("n"), F.col("total").alias("_t"))


def moments(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """(by, n, s, m): of the unit vectors of a group how many there are, their sum, and the sum of their outer products (flat).

    Vectors that are null, without length or not finite take no part; those of a group must be equally long, or Spark raises.
    """

    def summed(x: np.ndarray) -> np.ndarray | None:
        size = np.sqrt((x * x).sum(1))
        x, size = x[(size > 0) & np.isfinite(size)], size[(size > 0) & np.isfinite(size)]
        u = x / size[:, None]
        return np.r_[len(u), u.sum(0), (u.T @ u).ravel()] if len(u) else None

    return _cut(_by_group(rows, by, vector, summed), by)


def cross_moments(rows: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """(by, n, s, m): of the rows of a group that have all channels how many there are, their sums, and the sums of the products
    of any two channels (flat, row by row). One pass, whatever the number of channels; NaN counts as missing."""

    def summed(x: np.ndarray) -> np.ndarray | None:
        x = x[np.isfinite(x).all(1)]
        return np.r_[len(x), x.sum(0), (x.T @ x).ravel()] if len(x) else None

    vector = F.array(*[F.col(c).cast("double") for c in channels]).alias("_v")
    return _cut(_by_group(rows.select(*by, vector), by, "_v", summed), by)


def _cut(sums: DataFrame, by: list[str]) -> DataFrame:
    """Of 1 + d + d*d sums the first, the next d and the rest."""
    out = sums.withColumn("_d", ((F.sqrt(4 * F.size("_t") - 3.0) - 1) / 2).cast("int"))
    return out.select(*by, "n", F.slice("_t", 2, F.col("_d")).alias("s"), F.slice("_t", F.col("_d") + 2, F.col("_d") * F.col("_d")).alias("m"))


def cosine_spread(n: Column, s: Column, m: Column) -> tuple[Column, Column]:
    """Mean and population variance of the cosines of all pairs, from moments; null for under two vectors."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    pairs = F.when(n > 1, n * (n - 1))
    mean = (square(s) - n) / pairs
    return mean, F.when(n > 1, F.greatest(F.lit(0.0), (square(m) - n) / pairs - mean * mean))

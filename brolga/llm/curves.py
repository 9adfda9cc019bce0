"""Nearest neighbours by inner product along shifted Hilbert curves through random projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.llm.common import materialize, table

NEAREST = 20
#: Curves, projected dimensions and bits of each, vectors of a block; a query sees its own block and some on both sides.
CURVES, DIMS, BITS, BLOCK = 28, 6, 10, 800
SEED = 7
#: Queries that are answered by brute force too, and the share of those answers that the curves have to find.
SAMPLE, SURE = 256, 0.95
#: Rows of a block after which its queries so far are answered.
HELD = 1 << 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of cells (n, d) of a grid with 2**bits cells a side on the Hilbert curve through it.

    The transform of J. Skilling, "Programming the Hilbert curve" (2004), on whole columns.
    """
    x = cells.astype(np.int64).copy()
    d = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            high = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap if i else 0
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, d - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keys(size: int, longest: dict[int, float], small: set[int], curves: int, dims: int, bits: int):
    """Rows (curve, key, id, q) of (id, q, v, r). Candidates of a range r of norms have curves of their own, on which its
    longest vector bounds them: one more dimension makes them equally long, so that the nearest are those of the largest
    inner product. Queries lie on the curves of all ranges, as long as the candidates there, with 0 in that dimension.
    Ranges in small need one curve only."""
    first = {r: k * curves for k, r in enumerate(sorted(longest))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd = np.random.default_rng(SEED)
        bases = [(np.linalg.qr(rnd.normal(size=(size + 1, min(dims, size + 1))))[0], rnd.random(min(dims, size + 1))) for _ in range(curves)]
        reach = 3.5 / np.sqrt(size + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                q, v, r = part["q"].to_numpy(zero_copy_only=False), _matrix(part["v"]), part["r"].to_numpy()
                norm = np.sqrt((v**2).sum(1))
                most = np.where(q, norm, [longest[k] for k in r.tolist()])
                v = v / most[:, None]
                v = np.c_[v, np.where(q, 0.0, np.sqrt(np.maximum(0.0, 1 - (norm / most) ** 2)))]
                here = {k: np.flatnonzero(q | (r == k)) for k in longest if q.any() or (r == k).any()}
                for c, (basis, shift) in enumerate(bases):
                    cells = (np.clip((v @ basis / reach + 1) / 2, 0, 1) + shift) / 2 * ((1 << bits) - 1)
                    key = hilbert(cells, bits)
                    for k, own in here.items():
                        if not c or k not in small:
                            yield pa.record_batch({"curve": np.full(len(own), first[k] + c, np.int32), "key": key[own], "id": part["id"].take(pa.array(own)), "q": q[own]})

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition with the number of candidates of the curve so far."""
    part, last, before = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        curve, mine = batch["curve"].to_numpy(), ~batch["q"].to_numpy(zero_copy_only=False)
        total = np.cumsum(mine)
        new = np.r_[curve[0] != last, curve[1:] != curve[:-1]]
        base = np.where(new, np.r_[0, total[:-1]], 0)
        if not new[0]:
            base[0] = -before
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        local = total - base[head]
        last, before = int(curve[-1]), int(local[-1])
        yield pa.record_batch({"part": np.full(len(curve), part, np.int32), "curve": batch["curve"], "id": batch["id"], "q": batch["q"], "local": local})


def _rank(k: int):
    def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held).combine_chunks()
        q = group["q"].to_numpy()
        if q.all() or not q.any():
            return
        ids, v = group["id"].to_numpy(), _matrix(group["v"].combine_chunks())
        own, x = ids[~q], v[~q]
        order = np.argsort(own, kind="stable")
        own, x = own[order], x[order]
        for at in range(0, int(q.sum()), 1024):
            asked, y = ids[q][at : at + 1024], v[q][at : at + 1024]
            score = y @ x.T
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            yield pa.record_batch({"q": np.repeat(asked, top.shape[1]), "id": own[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch["curve"].to_numpy(), batch["block"].to_numpy()])
            if held and (held[-1]["curve"][0].as_py(), held[-1]["block"][0].as_py()) != tuple(group[:, 0].tolist()):
                yield from best(held)
                held = []
            cut = np.r_[0, np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1, batch.num_rows]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a:
                    yield from best(held)
                    held = []
                held.append(batch.slice(a, b - a))
            if sum(b.num_rows for b in held) > HELD and held[-1]["q"][-1].as_py():  # candidates come first
                yield from best(held)
                held = [own for b in held if (own := b.filter(pc.invert(b["q"]))).num_rows]
        if held:
            yield from best(held)

    return run


def _brute(ids: np.ndarray, asked: np.ndarray, k: int):
    """Rows (q, id, score): for each vector asked the k best of a task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, own = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                best = np.c_[best, asked @ _matrix(part["v"]).T]
                own = np.c_[own, np.broadcast_to(part["id"].to_numpy(), (len(asked), part.num_rows))]
                order = np.lexsort((own, -best), axis=1)[:, :k]
                best, own = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
        yield pa.record_batch({"q": np.repeat(ids, own.shape[1]), "id": own.ravel(), "score": best.ravel()})

    return run


def search(
    vectors: DataFrame, asked, k: int = NEAREST, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) found nearest to each row for which the column `asked` holds.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision, the largest first, ties to the
    smaller vec_id. A row never finds its own vec_id; with fewer than k others, all found are returned. Vectors that are
    null, zero or of another length than most, or hold a null or a non-finite number, take no part; nor do rows with a
    null vec_id. Repeated rows count once. Copies of a vector are one point with its k+1 smallest ids, which is all that
    can be asked for, so a large group of copies neither fills a block nor hides other vectors.

    Vectors lie in ranges of norms, each twice the one before, so a long vector only shapes the curves of its own range.
    Candidates are, in each range, those in the block of a query, of `block` distinct vectors, and in those beside it on each
    curve: one on both sides at first. SAMPLE queries are answered by brute force too; while the curves find less than SURE
    of those answers, twice as many blocks on both sides are seen, and where that would be more work than to compare all
    vectors, all blocks of one curve.
    """
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    known = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.coalesce(asked, F.lit(False)).alias("q")).where(
        "id is not null and v is not null"
    ).where(ok)
    sizes = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = sizes.n
    known = known.where(F.size("v") == size).groupBy("id", "v").agg(F.max("q").alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))

    first = known.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    points = materialize(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    by = known.where("q").groupBy("v").agg(F.min("id").alias("qid"))
    queries = known.where("q").join(by, "v").select(F.col("id").alias("query_id"), "qid")
    rows = points.select("id", F.lit(False).alias("q"), "v").union(by.select("qid", F.lit(True), "v"))
    rows = materialize(rows.withColumn("r", F.floor(F.log2(norm)).cast("int")))
    ranges = rows.where("not q").groupBy("r").agg(F.max(norm).alias("most"), F.count("*").alias("n")).collect()
    if not ranges:
        return vectors.sparkSession.createDataFrame([], schema)
    longest, most = {x.r: x.most for x in ranges}, sum(x.n for x in ranges)
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    tried = rows.where("q").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).select("id", "v").toArrow().combine_chunks()
    ids, asked_v = tried["id"].to_numpy(), _matrix(tried["v"].combine_chunks()) if len(tried) else np.zeros((0, size))
    real = rows.where("not q").mapInArrow(_brute(ids, asked_v, k + 1), "q long, id long, score double")
    real = materialize(real.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "id"))
    wanted, wide, lines = real.count(), 1, curves

    def places_on(lines: int) -> DataFrame:
        small = {x.r for x in ranges if x.n <= block}
        keys = rows.mapInArrow(_keys(size, longest, small, lines, dims, bits), "curve int, key long, id long, q boolean")
        dealt = keys.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "q", "id")
        places = materialize(dealt.mapInArrow(_places, "part int, curve int, id long, q boolean, local long"))
        counts = places.groupBy("part", "curve").agg(F.max("local").alias("n"))
        past = F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        counts = counts.select("part", "curve", F.coalesce(past, F.lit(0)).alias("past"))
        return places.join(F.broadcast(counts), ["part", "curve"]).withColumn("block", F.floor((F.col("past") + F.col("local") - F.when(F.col("q"), 0).otherwise(1)) / block))

    places = places_on(lines)
    while True:
        near = F.when(F.col("q"), F.sequence(F.greatest(F.lit(0), F.col("block") - wide), F.col("block") + wide)).otherwise(F.array("block"))
        at = places.select("curve", F.explode(near).alias("block"), "id", "q")
        seen = at.join(rows.drop("r"), ["id", "q"]).select("curve", "block", "q", "id", "v").repartition("curve", "block").sortWithinPartitions("curve", "block", "q")
        found = seen.mapInArrow(_rank(k + 1), "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
        found = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
        if wide > most // block or found.join(real, ["q", "id"]).count() >= SURE * wanted:
            break
        wide *= 2
        if lines * (2 * wide + 1) * block > 2 * most:
            lines, wide = 1, most // block + 1
            places = places_on(lines)

    def top(by: str, other: str, n: int):
        return F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), other)), n

    found = found.join(points.select("id", "ids"), "id")
    found = found.select(F.col("q").alias("qid"), F.explode("ids").alias("vec_id"), "score")
    place, n = top("qid", "vec_id", k + 1)
    found = found.withColumn("n", place).where(F.col("n") <= n).drop("n")
    place, n = top("query_id", "vec_id", k)
    out = queries.join(found, "qid").where("vec_id <> query_id").withColumn("rank", place).where(F.col("rank") <= n)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

import numpy as np
from pyspark.sql import functions as F

from brolga.llm.curves import hilbert, op6_curves, search

COLUMNS = "vec_id long, embedding array<float>"


def brute(rows, asked, k=20):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x):
        if asked(i):
            s = x @ v
            out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_curve_visits_every_cell_by_single_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_all_in_view_is_exact(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(120, 5)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 - i, x[3].tolist()) for i in range(60)] + [rows[4], (500, [0.0] * 5), (501, None), (502, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [(503, [float("nan")] * 5), (504, [float("inf")] + [0.0] * 4), (None, [1.0] * 5), (505, [1.0]), (520, (10 * x[7]).tolist())]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS + ", q int, id int").repartition(4)
    want = brute([r for r in rows if r[0] != 505], lambda i: i % 20 == 0)
    got = found(search(d, F.col("vec_id") % 20 == 0, curves=2))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    few = found(search(d.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0))
    assert len(few[0]) == 2 and search(d.limit(0), F.lit(True)).count() == 0


def test_small_blocks_lose_little(spark):
    rnd = np.random.default_rng(9)
    x = (rnd.normal(size=(40, 8))[rnd.integers(0, 40, 2000)] + 0.3 * rnd.normal(size=(2000, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, lambda i: i % 20 == 0)
    got = found(search(spark.createDataFrame(rows, COLUMNS).repartition(6), F.col("vec_id") % 20 == 0, curves=24, dims=4, block=60))
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) > 0.9


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows, lambda i: i % 20 == 0), found(op6_curves(spark, sf))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9


def recall(want, got):
    assert got.keys() == want.keys()
    return np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want])


def test_norms_far_apart_lose_little(spark):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(40, 8))[rnd.integers(0, 40, 3000)] + 0.3 * rnd.normal(size=(3000, 8))
    x[7] *= 1000
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    want = brute(rows, lambda i: i % 20 == 0)
    got = found(search(spark.createDataFrame(rows, COLUMNS).repartition(6), F.col("vec_id") % 20 == 0, curves=24, dims=4, block=60))
    assert recall(want, got) > 0.9


def test_window_grows_with_the_vectors(spark):
    rnd = np.random.default_rng(13)
    for n, curves in ((3000, 3), (6000, 3), (6000, 40)):
        x = rnd.normal(size=(n, 12)).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        want = brute(rows, lambda i: i % 50 == 0)
        got = found(search(spark.createDataFrame(rows, COLUMNS).repartition(6), F.col("vec_id") % 50 == 0, curves=curves, dims=4, block=20))
        assert recall(want, got) >= 0.9

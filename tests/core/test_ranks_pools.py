import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brolga.functions import ranks, vectors
from brolga.functions.intervals import as_of
from brolga.operators import audit, calibrate, diarize, enroll, evaluate, pools


def values(kind, n, rnd):
    if kind == "wide":
        return [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(n)]
    if kind == "late":
        return [1.7e12 + rnd.randint(0, 10**6) for _ in range(n)]
    if kind == "few":
        return [float(rnd.choice([-1.5, 0.0, -0.0, 2.0, math.inf, -math.inf])) for _ in range(n)]
    return [rnd.gauss(0, 1) for _ in range(n)]


def grouped():
    rnd = random.Random(3)
    rows = [(g, None if rnd.random() < 0.1 else v, rnd.choice("pnx")) for g in ("wide", "late", "few", "plain") for v in values(g, 400, rnd)]
    return rows + [(None, 3.0, "p"), (None, 2.0, "n"), (None, 3.0, "n"), (None, float("nan"), "p"), ("none", None, "p"), ("one", 5.0, "p")]


def test_ranks_auc_and_quantiles_of_any_distribution(spark):
    rows = grouped()
    d = spark.createDataFrame([(*r, 1) for r in rows], "g string, v double, label string, _value int").drop("_value").repartition(7)
    by = {}
    for g, v, x in rows:
        by.setdefault(g, []).append((v, x))
    got = ranks.average_ranks(d, ["g"], "v").toPandas()
    assert len(got) == len(rows)
    for g, own in got.groupby("g", dropna=False):
        g = None if g is None or g != g else g
        want = pd.Series([v for v, _ in by[g] if v is not None and v == v])
        told = own[own["rank"].notna()].sort_values("v")
        assert told["rank"].tolist() == want.rank().sort_values().tolist() and (told.n == len(want)).all()
    won = {r.g: r for r in ranks.pairs_won(d, ["g"], "v", F.col("label") == "p", F.col("label") == "n").collect()}
    mid = {r.g: r for r in ranks.quantiles(d, ["g"], "v", {"q10": 0.1, "q50": 0.5, "top": 1.0}).collect()}
    assert "none" not in won and "none" not in mid and mid["one"].q50 == 5.0
    for g, own in by.items():
        up, down = ([v for v, x in own if x == k and v is not None and v == v] for k in "pn")
        if g in won:
            assert (won[g].n_up, won[g].n_down) == (len(up), len(down))
            assert won[g].won == sum((a > b) + (a == b) / 2 for a in up for b in down)
        known = [v for v, _ in own if v is not None and v == v]
        if known and g != "few":
            assert np.allclose([mid[g].q10, mid[g].q50, mid[g].top], np.quantile(known, [0.1, 0.5, 1.0]), rtol=1e-12)
    assert ranks.average_ranks(d.limit(0), ["g"], "v").count() == 0


def test_cells_spread_a_single_channel(spark):
    """However large one group is, its different values fall into many cells, which tasks sort apart."""
    d = spark.range(20000).select(F.lit(1).alias("g"), F.randn(4).alias("v"))
    sizes = ranks._cells(d, ["g"], "v", {"n": F.count("*")}).groupBy("g", "_place", "_power").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 200 and sizes[1] > 500


def test_as_of_hands_spans_over_stretches(spark):
    rnd = random.Random(8)
    spans = [(rnd.choice(["a", "b", None]), rnd.randint(0, 2000), rnd.randint(1, 900)) for _ in range(120)]
    spans = [(g, s, s + n, f"{g}{s}-{n}") for g, s, n in spans] + [("a", None, 5, "lost")]
    points = [(rnd.choice(["a", "b", None, "c"]), rnd.choice([None, rnd.randint(-50, 3000)]), k) for k in range(400)]
    s = spark.createDataFrame(spans, "g string, start_ms long, end_ms long, name string")
    p = spark.createDataFrame(points, "g string, t long, k long")
    want = []
    for g, t, k in points:
        before = [x for x in spans if x[0] == g and t is not None and x[1] is not None and x[1] <= t]
        last = max(before, key=lambda x: (x[1], x[2]), default=None)
        hit = last if last and t < last[2] else None
        want.append((k, hit and hit[3], hit and t - hit[1]))
    for width in (1.0, 70.0, 1e9):
        got = as_of(p, s, ["g"], "t", ["name"], width).select("k", "name", "elapsed_ms").collect()
        same = sorted(tuple(r) for r in got)
        assert [(a[0], a[2]) for a in same] == [(a[0], a[2]) for a in sorted(want)]
        assert all(a[1] == b[1] or (a[1] and a[1].split("-")[1] == b[1].split("-")[1]) for a, b in zip(same, sorted(want)))


def test_labels_by_latest_start(spark):
    w = spark.createDataFrame([(1, 1, 400, 600), (1, 2, 1000, 1400), (1, 3, 0, 10)], "f int, window_id int, start_time_ms long, end_time_ms long")
    p = spark.createDataFrame([(1, 50, 5000, "old"), (1, 400, 900, "new")], "f int, start_ms long, end_ms long, label string")
    got = {r.window_id: r.target_ground_truth for r in calibrate.label_midpoints(w, p, ["f"]).collect()}
    assert got == {1: "new", 2: "unlabeled", 3: "unlabeled"}


def test_chain_with_missing_links(spark):
    rows = [("a", 0, "h0", "genesis"), ("a", 1, "h1", None), ("a", 2, "h2", "h1"), ("b", 0, "g0", "genesis"), ("b", None, "g1", "g0"), ("c", 0, "x", "genesis"), ("c", 1, None, "x")]
    log = spark.createDataFrame(rows, "log string, seq long, entry_sha string, prev_sha string")
    assert {r.log: r.first_bad for r in audit.verify_chain(log).collect()} == {"a": 1, "b": 0, "c": None}
    assert audit.bad_ms('{"a_ms": null, "b_ms": true, "c": [{"d_ms": 1.0, "e_ms": 3}]}') == ["a_ms", "b_ms", "c.0.d_ms"]


def test_identities_keep_their_first_face(spark):
    at = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    rows = [(1, k, at(a), s) for k, (a, s) in enumerate([(0, 0.9), (60, 0.7), (85, 0.8), (20, 0.6)])] + [(2, 0, None, 0.5), (2, 1, at(0), 0.4)]
    f = spark.createDataFrame(rows, "file_index long, face_id long, embedding array<double>, score double")
    c = enroll.cluster_identities(f.where("file_index = 1"))
    assert [r.identity for r in c.orderBy("face_id").collect()] == [0, 0, 1, 0]
    assert [tuple(r)[1:] for r in enroll.identities(c, f).orderBy("place").collect()] == [(0, 3, pytest.approx(0.7333333), 1), (1, 1, 0.8, 2)]


def test_default_bounds_of_voices(spark):
    x = spark.createDataFrame([(0.58,), (0.61,), (None,)], "s double").select(enroll.too_like(F.col("s")).alias("x")).collect()
    assert [r.x for r in x] == [False, True, False]


def test_scorecard_puts_tracked_channels_first(spark):
    rows = [(s, c, 40, 40, a, d) for s in (0, 1, 2) for c, a, d in (("b", 0.9, 1), ("a", 0.9, 1), ("t", 0.4, 0), ("z", 0.7, 0))]
    card = evaluate.scorecard(spark.createDataFrame(rows, "subject int, channel string, n_pos long, n_neg long, auc double, dir int"), [0, 1, 2], ["t"])
    assert [(r.channel, r.verdict, r.tracked, r.place) for r in card.collect()] == [("t", "NO-SIGNAL", True, 1), ("a", "REPLICATES", False, 2), ("b", "REPLICATES", False, 3), ("z", "SUBJECT-SPECIFIC", False, 4)]


def test_moments_and_sums(spark):
    rnd = np.random.default_rng(1)
    rows = [(k % 3 if k % 7 else None, rnd.standard_normal(4).tolist(), k % 5) for k in range(60)] + [(0, None, 1), (1, [0.0] * 4, 1), (2, [float("nan")] * 4, 1)]
    d = spark.createDataFrame(rows, "g int, vector array<double>, w int").repartition(4)
    got = {r.g: r for r in vectors.moments(d, ["g"]).collect()}
    sums = {r.g: r for r in vectors.vector_sums(d.where("not isnan(coalesce(vector[0], 0))"), ["g"], weight=F.col("w")).collect()}
    for g in (0, 1, 2, None):
        v = np.array([x for k, x, _ in rows if k == g and x and np.isfinite(x).all() and any(x)])
        w = np.array([n for k, x, n in rows if k == g and x and np.isfinite(x).all() and any(x)])
        assert np.allclose(sums[g].total, (v * w[:, None]).sum(0))
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        assert got[g].n == len(u) and np.allclose(got[g].s, u.sum(0)) and np.allclose(got[g].m, (u.T @ u).ravel())
        told = diarize.pair_variance(d.where(F.col("g").eqNullSafe(F.lit(g))), ["g"]).first()
        cosines = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert np.allclose([told["mean"], told.variance], [cosines.mean(), cosines.var()])


def plain_enrolment(rows):
    """The same, one candidate after another."""
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    mean = lambda pool: sum(np.array(r["vector"]) * r["duration_ms"] for r in pool)

    def var(pool):
        c = [cos(a["vector"], b["vector"]) for k, a in enumerate(pool) for b in pool[k + 1 :]]
        return float(np.var(c)) if c else 0.0

    def gate(r, seed, anti):
        if r["vad_coverage"] < 0.5 or (r["closed_share"] is not None and r["closed_share"] < 0.8):
            return "A"
        if seed is None or cos(r["vector"], seed) < 0.7:
            return "B"
        if anti is not None and (cos(r["vector"], anti) > 0.5 or cos(r["vector"], seed) - cos(r["vector"], anti) < 0.15):
            return "C"
        return None

    files, accepted = {}, {}
    for s in sorted({r["session"] for r in rows}):
        own = [r for r in rows if r["session"] == s]
        seeds = [r for r in own if r["kind"] == "seed"]
        seed = mean(seeds) if seeds else None
        mine, other, last, halted = [], [], None, False
        for f in sorted({r["file_index"] for r in own}):
            here = [r for r in own if r["file_index"] == f]
            mine += [r for r in here if r["kind"] == "seed"]
            other += [r for r in here if r["kind"] == "click"]
            failed = []
            for r in here:
                if r["kind"] == "voice":
                    why = gate(r, seed, mean(other) if other else None)
                    if why is None:
                        mine.append(r)
                        accepted[r["candidate_id"]] = 1
                    elif why == "C":
                        failed.append(r)
            other += [r for r in here if r["kind"] == "anti" and seed is not None and cos(r["vector"], seed) <= 0.6]
            widened = bool(other) and last is not None and var(other) - last > 0.05
            last = var(other) if other else last
            like = cos(mean(mine), mean(other)) if mine and other else None
            halted = halted or (like is not None and like > 0.6)

            def state(mine=mine, other=other):
                ms = sum(r["duration_ms"] for r in mine)
                return "STRONG" if ms >= (45000 if other else 60000) and var(mine) <= 0.05 else "MARGINAL" if ms >= 20000 else "INSUFFICIENT"

            now, again = state(), 0
            if now == "MARGINAL" and other:
                for r in failed:
                    if gate(r, seed, mean(other)) is None:
                        mine.append(r)
                        accepted[r["candidate_id"]] = 2
                        again += 1
                now = state()
            files[s, f] = (now, sum(r["duration_ms"] for r in mine), len(mine), round(var(mine), 9), len(other), round(var(other), 9), widened, like and round(like, 9), again, halted)
    return accepted, files


def test_enrolment_against_one_candidate_after_another(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for k in range(700):
        s = f"s{k % 5}"
        axis = np.eye(6)
        kind = "seed" if k // 5 in (0, 3) and s != "s4" else "click" if k == 36 else "anti" if k // 5 % 4 == 1 else "voice"
        f = k // 5 // 20
        v = {"seed": axis[0] * 3, "click": axis[1] * 2, "anti": axis[1] * rnd.uniform(1, 2) + axis[0] * (1.1 - 0.35 * f) + axis[2] * (f * (s == "s2")) + axis[3] * rnd.normal(0, 2 * (f > 3)), "voice": axis[0] * rnd.uniform(1, 3) + axis[1] * rnd.uniform(0, 1.6)}[kind]
        v = v + rnd.normal(0, 0.3, 6)
        rows.append(dict(session=s, file_index=f, candidate_id=k, kind=kind, vector=v.tolist(), duration_ms=int(rnd.integers(300, 1500)) * (1 + k % 5), vad_coverage=float(rnd.uniform(0.45, 1)), closed_share=None if k % 3 else float(rnd.uniform(0.75, 1))))
    accepted, files = plain_enrolment(rows)
    kinds = "session string, file_index long, candidate_id long, kind string, vector array<double>, duration_ms long, vad_coverage double, closed_share double"
    d = spark.createDataFrame([*[tuple(r.values()) for r in rows], (None, 1, -1, "voice", [1.0] * 6, 1, 1.0, None), ("s1", 1, -2, "voice", None, 1, 1.0, None), ("s1", 1, -3, None, [1.0] * 6, 1, 1.0, None)], kinds).repartition(5)
    told, state = pools.enrol(d.withColumn("state", F.lit("clash")))
    got = told.collect()
    assert {r.candidate_id: r.accepted_in for r in got if r.kind == "voice" and r.accepted_in} == accepted and 2 in accepted.values()
    assert len(got) == len(rows)
    seen = {(r.session, r.file_index): (r.state, r.verified_ms, r.pool_size, round(r.pool_variance, 9), r.anti_pool_size, round(r.anti_variance, 9), r.anti_widened, r.contamination and round(r.contamination, 9), r.second_pass, r.halted) for r in state.collect()}
    assert seen.keys() == files.keys()
    for k in files:
        assert seen[k][:3] == files[k][:3] and seen[k][4] == files[k][4] and seen[k][6] == files[k][6] and seen[k][8:] == files[k][8:], (k, seen[k], files[k])
        assert np.allclose([seen[k][3], seen[k][5], seen[k][7] or 0], [files[k][3], files[k][5], files[k][7] or 0], atol=1e-7)
    assert {v[0] for v in files.values()} == {"STRONG", "MARGINAL", "INSUFFICIENT"} and any(v[9] for v in files.values())
    none, empty = pools.enrol(d.limit(0))
    assert none.count() == 0 and empty.count() == 0

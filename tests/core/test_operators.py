"""Planted cases for what the SQL comparison does not reach."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brolga.functions.exprs import average_rank, percentile_rank, regularised, weighted_mean
from brolga.functions.intervals import as_of, contain_join, merge_spans, overlap_join
from brolga.operators import audit, calibrate, diarize, enroll, evaluate, frames, graph, report, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_weighting(spark):
    d = spark.createDataFrame([(5.0, 0.1), (2.0, 0.5), (None, 0.9), (3.0, None)], "v double, w double")
    assert rows(d.select(regularised(F.col("v"), F.col("w")))) == [(0.5,), (2.0,), (None,), (None,)]
    assert abs(d.agg(weighted_mean(F.col("v"), F.col("w"))).first()[0] - (0.05 + 1.0) / 0.6) < 1e-12
    assert d.where("w is null").agg(weighted_mean(F.col("v"), F.col("w"))).first()[0] is None


def test_ranks(spark):
    d = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 3.0, None, 2.0)], "g string, x double")
    out = d.select("x", average_rank(F.col("x"), F.col("g")), percentile_rank(F.col("x"), F.col("g"))).collect()
    assert sorted(((r[0], r[1], r[2]) for r in out), key=str) == [(1.0, 1.0, 0.25), (2.0, 2.0, 0.5), (3.0, 3.5, 0.875), (3.0, 3.5, 0.875), (None, None, None)]


def test_joins_against_brute_force(spark):
    rnd = random.Random(1)
    spans = [(k % 3, a := rnd.randint(0, 9000), a + rnd.choice([0, 5, 700, 4000])) for k in range(80)]
    points = [(k % 4, float(rnd.randint(0, 12000))) for k in range(300)]
    s = spark.createDataFrame(spans, "g long, start_ms long, end_ms long")
    p = spark.createDataFrame(points, "g long, t double")
    want = sorted((g, t, a, b) for g, t in points for h, a, b in spans if g == h and a <= t < b)
    assert sorted(rows(contain_join(p, s, ["g"], "t").select("g", "t", "start_ms", "end_ms"))) == want
    other = s.select("g", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    want = sorted((g, a, b, c, e) for g, a, b in spans for h, c, e in spans if g == h and a < e and c < b)
    assert sorted(rows(overlap_join(s, other, ["g"]).select("g", "start_ms", "end_ms", "r_start", "r_end"))) == want


def test_as_of_looks_at_the_latest_start_only(spark):
    s = spark.createDataFrame([(0, 0.0, 100.0, "long"), (0, 10.0, 20.0, "short")], "g int, start_ms double, end_ms double, name string")
    p = spark.createDataFrame([(0, t) for t in (-1.0, 5.0, 10.0, 19.0, 20.0, 50.0)] + [(1, 5.0)], "g int, t double")
    got = {(r.g, r.t): (r.name, r.elapsed_ms) for r in as_of(p, s, ["g"], "t", ["name"]).collect()}
    assert got == {(0, -1.0): (None, None), (0, 5.0): ("long", 5.0), (0, 10.0): ("short", 0.0), (0, 19.0): ("short", 9.0), (0, 20.0): (None, None), (0, 50.0): (None, None), (1, 5.0): (None, None)}


def test_speech_goldens(spark):
    def segments(probs, **kw):
        d = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(probs)], "file_index long, idx long, prob double")
        return sorted((r.start_ms, r.end_ms) for r in diarize.speech_segments(d, **kw).collect())

    assert segments([1] * 10 + [0] * 20) == [(0, 350)]
    assert segments([1] * 8 + [0] * 2 + [1] * 8 + [0] * 5) == [(0, 606)]
    assert segments([1] * 8 + [0] * 4 + [1] * 8) == [(0, 286), (354, 640)]
    assert segments([1] * 5 + [0] * 20) == [] and segments([0] * 5) == []


def test_merge_touching(spark):
    d = spark.createDataFrame([(0, 0, 10), (0, 10, 20), (0, 21, 30), (0, 5, 5), (1, 0, 100), (1, 10, 20)], "g int, start_ms long, end_ms long")
    assert sorted(rows(merge_spans(d, ["g"]).select("g", "start_ms", "end_ms", "n_merged"))) == [(0, 0, 20, 2), (0, 21, 30, 1), (1, 0, 100, 2)]


def test_bridging_refusals(spark):
    sub = spark.createDataFrame([(0, 0, 1000, 1), (0, 1300, 2000, 1), (0, 2400, 3000, 1), (0, 3200, 4000, 2), (0, 4300, 5000, 1), (0, 5100, 6000, 1)], "file_index long, start_ms long, end_ms long, n_merged long")
    regions = spark.createDataFrame([(0, 3050, 3100)], "file_index long, start_ms long, end_ms long")
    blocks = spark.createDataFrame([(0, 4, "MEDIUM", True, 0.6, 0.5), (0, 5, "HIGH", False, 0.6, 0.2)], "file_index long, block long, tier string, margin_failed boolean, s_target double, s_interviewer double")
    got = sorted(rows(diarize.bridge(sub, regions, blocks).select("start_ms", "end_ms", "blocks", "bridged")))
    assert got == [(0, 2000, 2, 1), (2400, 3000, 1, 0), (3200, 4000, 2, 0), (4300, 6000, 2, 1)]


RUNS = "file_index long, run long, first_block long, last_block long, n long"
FINE = "file_index long, start_ms long, end_ms long, s_target double, s_interviewer double"


def test_edge_trim(spark):
    runs = spark.createDataFrame([(0, 7, 7, 11, 5), (0, 20, 20, 20, 1), (1, 0, 0, 1, 2), (2, 3, 3, 5, 3)], RUNS)
    dur = spark.createDataFrame([(0, 60000), (1, 2000), (2, 60000)], "file_index long, duration_ms long")
    fine = [(0, 7250, 9250, 0.9, None), (0, 7500, 9500, 0.9, None), (0, 9750, 11750, 0.9, 0.1), (0, 10000, 12000, 0.9, 0.8), (2, 3000, 5000, 0.7, 0.1), (2, 3250, 5250, 0.5, 0.1), (2, 4000, 6000, 0.7, 0.6)]
    got = {r.run: (r.start_ms, r.end_ms, r.lead_demoted, r.tail_demoted) for r in diarize.edge_trim(runs, dur, spark.createDataFrame(fine, FINE), 0.6).collect()}
    # the interviewer is too near at 12000, so the run ends at 11750; a run of one block is used up; one without scores keeps its end
    assert got == {7: (7250, 11750, False, False), 0: (1000, 2000, True, False), 3: (3000, 5000, False, True)}
    alone = {r.run: (r.start_ms, r.end_ms) for r in diarize.edge_trim(runs, dur, spark.createDataFrame(fine, FINE), 0.6, anti=False).collect()}
    assert alone[7] == (7250, 12000) and alone[3] == (3000, 6000)
    spans = diarize.fine_plan(runs, dur).where("run = 0").collect()
    assert all(r.end_ms - r.start_ms >= 1000 and 0 <= r.start_ms and r.end_ms <= 2000 for r in spans) and {r.p for r in spans if r.lead} == {0, 250, 500, 750, 1000}


def test_thresholds(spark):
    def told(genuine, impostor, anti=True):
        frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "s double")
        r = diarize.thresholds(frame(genuine), frame(impostor), anti).first()
        return round(r.theta_high, 9), round(r.theta_med, 9), r.calibration, r.overlapping

    g = [x / 20 for x in range(10, 20)]
    assert told(g[:3], [0.2]) == (0.6, 0.4, "FALLBACK_DEFAULTS", False)
    assert told(g, [0.3]) == (0.545, 0.395, "DERIVED", False)
    assert told(g, [0.6]) == (0.65, 0.5, "DERIVED", False) and told(g, [0.72]) == (0.75, 0.6, "DERIVED", True)
    assert told(g, []) == (0.55, 0.4, "DERIVED_NO_ANTI", False) and told(g, [0.9], anti=False) == (0.55, 0.4, "DERIVED_NO_ANTI", False)
    assert told([0.1] * 12, [0.0]) == (0.45, 0.3, "DERIVED", False)


def test_tiers(spark):
    d = spark.createDataFrame([(0.9, None), (0.9, 0.8), (0.9, 0.1), (0.5, 0.1), (0.25, None), (0.1, None), (None, None)], "s_target double, s_interviewer double")
    got = [(r.tier, r.margin_failed) for r in diarize.tiers(d, F.lit(0.6), F.lit(0.4)).collect()]
    assert got == [("MEDIUM", True), ("MEDIUM", True), ("HIGH", False), ("MEDIUM", False), ("SUB", False), ("REJECT", False), ("SKIPPED", False)]
    assert [r.tier for r in diarize.tiers(d, F.lit(0.6), F.lit(0.4), anti=False).collect()][:3] == ["HIGH"] * 3


def test_drift_is_a_fall_from_all_of_the_file_before(spark):
    blocks = [(0, k, 0.9 if k < 30 else 0.5, "HIGH") for k in range(100)] + [(1, 0, 0.1, "REJECT")] + [(2, k, 0.7, "HIGH") for k in range(5)]
    blocks += [(5000, k, 0.58 if k < 30 else 0.9, "HIGH") for k in range(40)] + [(5001, 0, 0.9, "HIGH")]
    d = spark.createDataFrame(blocks, "file_index long, block long, s_target double, tier string")
    got = {r.file_index: (r["mean"], r.previous, r.drifted) for r in diarize.drift(d).collect()}
    assert got[1][0] is None and abs(got[2][1] - 0.62) < 1e-9 and not got[2][2] and got[0][1] is None
    assert got[5000][2] and abs(got[5000][0] - 0.58) < 1e-9 and not got[5001][2]


def test_running_values_over_stretches(spark):
    from brolga.functions.prefix import last_before, sum_before

    rnd = random.Random(9)
    data = [(k, rnd.choice([None, float(k)]), rnd.randint(0, 9)) for k in sorted(rnd.sample(range(-50, 400), 120))]
    d = spark.createDataFrame(data, "k long, v double, n long").repartition(5)
    for width in (1, 7, 1024):
        got = {r.k: r.past for r in last_before(d, "k", "v", "past", width).collect()}
        assert got == {k: next((v for j, v, _ in reversed(data) if j < k and v is not None), None) for k, _, _ in data}
        got = {r.k: r.total for r in sum_before(d, "k", {"total": F.col("n")}, width).collect()}
        assert got == {k: sum(n for j, _, n in data if j < k) for k, _, _ in data}


def test_quality_and_stability(spark):
    d = spark.createDataFrame([(50_000, 0.01), (70_000, 0.01), (70_000, 0.2), (100, 0.0)], "ms long, variance double")
    assert [r.quality for r in enroll.quality(d).collect()] == ["STRONG", "STRONG", "MARGINAL", "INSUFFICIENT"]
    assert [r.quality for r in enroll.quality(d, anti=False).collect()] == ["MARGINAL", "STRONG", "MARGINAL", "INSUFFICIENT"]
    rows_ = [(0, "base", float(k)) for k in range(100)] + [(0, "negative", 50.0 if k % 2 else 200.0) for k in range(20)] + [(0, "positive", 500.0) for _ in range(20)]
    w = spark.createDataFrame(rows_, "subject int, label string, v double")
    r = evaluate.stability(w, "v", F.col("label") == "base").first()
    # half of the negative class is over the baseline's bound: fewer than the positive one, but far more than the baseline
    assert r.flag_pos == 1.0 and r.flag_neg == 0.5 and abs(r.flag_base - 0.05) < 1e-9 and not r.stable


def test_pair_variance_against_pairs(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(40, 5))
    d = spark.createDataFrame([(k % 2, x.tolist()) for k, x in enumerate(v)] + [(0, None), (1, [0.0] * 5), (2, [1.0] * 5)], "g long, vector array<double>").repartition(3)
    for r in diarize.pair_variance(d, ["g"]).collect():
        u = v[r.g :: 2] / np.linalg.norm(v[r.g :: 2], axis=1)[:, None]
        c = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert r.n == len(u) and abs(r["mean"] - c.mean()) < 1e-9 and abs(r.variance - c.var()) < 1e-9


def test_guarded_job(spark):
    clips = [(0, f, k * 1000 / 30, 0.9 if f != 1 else 0.0, 0.1 * k, 1.0) for f in range(3) for k in range(200)]
    d = spark.createDataFrame(clips, "recording_id long, file_index long, timestamp double, joint_confidence double, AU12 double, is_audio_active double")
    d = d.withColumns({"is_blinking": F.lit(0), "emotion_label": F.lit("N/A")})
    job = lambda rows, **kw: calibrate.recording_job(rows, windows.Sliding(channels=("AU12",)), **kw)
    assert {r.file_index for r in job(d, guard=True).collect()} == {0, 2} and {r.file_index for r in job(d).collect()} == {0, 1, 2}
    with pytest.raises(calibrate.CalibrationError):
        job(d.where("file_index = 1 or file_index = 2 and timestamp < 100"), guard=True)


def test_baseline(spark):
    w = spark.createDataFrame([(0, 0, k, k * 1000.0, float(k + 1), 7.0) for k in range(4)] + [(0, 1, 0, 0.0, 9.0, 8.0), (0, 1, 1, 1000.0, None, None)], "recording_id long, file_index long, window_id long, start_time_ms double, a double, b double")
    stats = calibrate.fit_baseline(w, ["a", "b"])
    got = {r.channel: (r["mean"], r["std"]) for r in stats.collect()}
    assert got["a"][0] == 2.5 and abs(got["a"][1] - math.sqrt(5 / 3)) < 1e-12 and got["b"] == (7.0, None)
    out = {(r.file_index, r.window_id): r for r in calibrate.apply_baseline(w, stats, ["a", "b"]).collect()}
    z = (9 - 2.5) / math.sqrt(5 / 3)
    assert abs(out[1, 0].deviation_magnitude - z) < 1e-12 and out[1, 0].b == 8.0 and out[1, 1].deviation_magnitude == 0.0
    calibrate.check_baseline(w, stats)
    with pytest.raises(calibrate.CalibrationError):
        calibrate.check_baseline(w.where("file_index = 1").limit(1), calibrate.fit_baseline(w.where("file_index = 1").limit(1), ["a"]))
    assert calibrate.feature_columns(w.withColumns({"blink_count": F.lit(1), "target_ground_truth": F.lit(2)})) == ["a", "b"]


def test_baseline_index(spark):
    d = spark.createDataFrame([("x/rec_007_windowed_features.csv",), ("other.csv",)], "p string")
    assert rows(d.select(calibrate.baseline_index(F.col("p"), 3))) == [(7,), (3,)]


def test_verdicts(spark):
    def subject(channel, k, auc, way, n=40):
        return (channel, k, n, n, auc, way)

    table = [subject("rep", k, 0.7, 1) for k in range(3)] + [subject("dir", k, 0.52, -1) for k in range(3)] + [subject("own", k, 0.8 if k == 0 else 0.5, 0) for k in range(3)]
    table += [subject("none", k, 0.5, 0) for k in range(3)] + [subject("few", k, 0.9, 1, 10) for k in range(3)] + [subject("split", k, 0.7, 1 if k else -1) for k in range(3)]
    d = spark.createDataFrame(table, "channel string, subject int, n_pos int, n_neg int, auc double, dir int")
    got = {r.channel: r.verdict for r in evaluate.verdicts(d).collect()}
    assert got == {"rep": "REPLICATES", "dir": "DIRECTION-ONLY", "own": "SUBJECT-SPECIFIC", "none": "NO-SIGNAL", "few": "INSUFFICIENT-DATA", "split": "SUBJECT-SPECIFIC"}


def test_clip_offsets_do_not_hide_a_channel(spark):
    rnd = np.random.default_rng(3)
    table = []
    for clip in range(3):
        for k in range(100):
            lie = k % 2 if clip else k % 10 == 0
            table.append((0, clip, k, "positive" if lie else "negative", "c", float(rnd.normal() + 2 * lie + 8 * (clip == 0) * 1.0 + 3)))
    d = spark.createDataFrame(table, "subject long, clip long, window_id long, label string, channel string, value double")
    assert evaluate.subject_scores(d).first().auc > 0.8


def test_leave_one_subject_out(spark):
    rnd = np.random.default_rng(4)
    table = [(s, 0, k, "positive" if k % 2 else "negative", float(rnd.normal() + 1.5 * (k % 2)), float(rnd.normal()), None) for s in range(4) for k in range(80)]
    d = spark.createDataFrame(table, "subject long, clip long, window_id long, label string, a double, b double, c double")
    said = evaluate.loso(d, ["a", "b"]).withColumn("value", F.col("score"))
    auc = evaluate.rank_auc(said, ["subject"], evaluate.is_label("positive"), evaluate.is_label("negative"))
    assert all(r.auc > 0.75 for r in auc.collect()) and evaluate.loso_summary(auc).first().verdict == "GENERALIZES"
    assert evaluate.loso_summary(auc.limit(0)).first().verdict == "INSUFFICIENT"


def test_spectrum():
    t = np.arange(120) / 30
    one = windows.band_metrics(np.sin(2 * np.pi * 6 * t))
    assert abs(one["tremor"][1] - 6) <= 0.5 and one["tremor"][0] > 100 * one["sway"][0]
    both = windows.band_metrics(np.sin(2 * np.pi * 6 * t) + np.sin(2 * np.pi * t))
    assert abs(both["sway"][1] - 1) <= 0.5
    x = np.sin(2 * np.pi * 6 * t)
    x[50:60] = np.nan
    assert abs(windows.band_metrics(x)["tremor"][1] - 6) <= 0.5
    x[40:90] = np.nan
    assert windows.band_metrics(x)["tremor"] == (None, None, None) and windows.band_metrics(np.ones(120))["sway"][1] is None
    assert windows.fill_gaps(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]
    assert windows.band_metrics(np.zeros(5))["tremor"] == (None, None, None)


def test_spectra_against_a_plain_transform(spark):
    x = np.random.default_rng(5).normal(size=117)
    got = windows.band_metrics(x)["tremor"]
    n = len(x)
    i = np.arange(n)
    y = (x - np.polyval(np.polyfit(i, x, 1), i)) * np.hanning(n)
    f = np.fft.rfftfreq(n, 1 / 30)
    p = np.array([2 / (n * 30) * abs(sum(y * np.exp(-2j * np.pi * k * i / n))) ** 2 for k in range(len(f))])
    inside = (f >= 4) & (f <= 10)
    assert abs(got[0] - p[inside].sum() * (f[1] - f[0])) < 1e-9 and got[1] == f[inside][p[inside].argmax()]


def test_codebook(spark):
    rnd = np.random.default_rng(6)
    d = spark.createDataFrame([(k, (rnd.normal(size=3) + 10 * (k % 3)).tolist()) for k in range(90)], "k long, latent array<double>")
    book = windows.fit_codebook(d, kinds=3)
    got = windows.codebook_assign(d, book).collect()
    assert len({(r.k % 3, r.code) for r in got}) == 3


def see(t, here=True, turned=False, mar=0.2, other=False, omar=None, speech=True):
    return (0, t, here, turned, mar, other, omar, speech)


OBS = "file_index long, t_ms long, here boolean, turned boolean, mar double, other_here boolean, other_mar double, speech boolean"


def test_capture(spark):
    talk = [see(t) for t in range(0, 1000, 100)]
    cases = {
        "expired": talk + [see(t, speech=False) for t in range(1000, 2000, 100)],
        "interjection": talk + [see(t, speech=False, other=True, omar=0.3) for t in range(1000, 1300, 100)],
        "end": talk,
    }
    for why, obs in cases.items():
        got = enroll.capture_windows(spark.createDataFrame(obs, OBS)).collect()
        assert [r.reason for r in got] == [why] and got[0].start_ms == 0
        assert got[0].stop_ms == {"expired": 1500, "interjection": 1100, "end": 900}[why]
    pause = talk + [see(1000, speech=False), *[see(t, turned=True, speech=False) for t in range(1100, 1600, 100)], *[see(t, speech=False) for t in range(1600, 2400, 100)]]
    assert [r.stop_ms for r in enroll.capture_windows(spark.createDataFrame(pause, OBS)).collect()] == [2000]
    again = talk + [see(1000, speech=False), see(1100)] + [see(1200, speech=False)]
    assert [(r.stop_ms, r.reason) for r in enroll.capture_windows(spark.createDataFrame(again, OBS)).collect()] == [(1200, "end")]
    assert enroll.capture_windows(spark.createDataFrame([see(0, mar=None), see(100, here=False)], OBS)).count() == 0


def test_spacing_and_identities(spark):
    d = spark.createDataFrame([(0, t) for t in (0, 500, 1999, 2000, 3500, 4100)] + [(1, 7)], "file_index long, t_ms long")
    assert sorted(rows(enroll.spaced(d))) == [(0, 0), (0, 2000), (0, 4100), (1, 7)]
    f = spark.createDataFrame([(0, k, [1.0, 0.1 * k] if k % 2 else [-1.0, 0.0]) for k in range(6)], "file_index long, face_id long, embedding array<double>")
    assert {(r.face_id % 2, r.identity) for r in enroll.cluster_identities(f).collect()} == {(0, 0), (1, 1)}


def test_nearest_face(spark):
    clicks = spark.createDataFrame([(0, 1, 1000, 5.0, 5.0), (0, 2, 9000, 0.0, 0.0)], "file_index long, click_id long, t_ms long, x double, y double")
    faces = spark.createDataFrame([(0, 1, 1190, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 2, 950, 20.0, 20.0, 30.0, 30.0, 0.9), (0, 3, 950, 0.0, 0.0, 9.0, 9.0, 0.5)], "file_index long, face_id long, t_ms long, x0 double, y0 double, x1 double, y1 double, score double")
    assert rows(enroll.nearest_face(clicks, faces).select("click_id", "face_id", "inside")) == [(1, 3, True)]


def test_canonical_and_ms(spark):
    d = spark.createDataFrame([('{"b": 1, "a": {"x_ms": 1.5, "y_ms": 2, "z_ms": true}}',), ("oops",), (None,)], "payload string")
    a, b, c = audit.with_hashes(d).collect()
    assert a.bad_ms == ["a.x_ms", "a.z_ms"] and b.payload_sha256 is None and b.bad_ms == ["not JSON"] and c.payload_sha256 is None and c.bad_ms == []
    assert audit.canonical('{"b":1,"a":"é"}') == '{"a":"\\u00e9","b":1}' and audit.canonical('{"a": NaN}') is None


def test_unwrap(spark):
    d = spark.createDataFrame([('{"operation":"x","payload":{"k":1},"worker":2}',), ('{"payload":1}',)], "record string")
    assert [r.body for r in audit.unwrap(d).collect()] == ['{"k":1}', '{"payload":1}']


def test_stems_and_containers(spark):
    d = spark.createDataFrame([("/a/Clip_01_canonical_16k.WAV",), ("b\\x_hubert.mp4",)], "p string")
    assert rows(d.select(diarize.stem(F.col("p")))) == [("clip_01",), ("x",)]
    p = spark.createDataFrame([(0, '{"start_time":"0.0125","r_frame_rate":"30/1","avg_frame_rate":"60/2"}'), (1, '{"r_frame_rate":"30/1","avg_frame_rate":"2997/100"}')], "file_index int, probe string")
    assert rows(diarize.container_facts(p)) == [(0, 12, False, False), (1, None, True, True)]


def test_graph(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=400)
    d = spark.createDataFrame([(float(a), float(2 * a + 0.1 * b), float(b)) for a, b in zip(x, rnd.normal(size=400))], "a double, b double, c double")
    w = {(r.channel, r.neighbour): r.weight for r in graph.neighbour_models(d, ["a", "b", "c"]).collect()}
    assert abs(w["b", "a"] - 2) < 0.3 and abs(w["c", "a"]) < 1
    long = spark.createDataFrame([(0, i, c, 1 if i < 100 else 0) for i in range(180) for c in "xy"], "file_index long, idx long, channel string, valid int")
    assert sorted(r.window for r in graph.model_windows(long).collect()) == [0, 1, 2, 3, 4, 5]
    nodes, edges = spark.createDataFrame([("p",), ("q",), ("r",)], "node string"), spark.createDataFrame([("p", "q")], "a string, b string")
    adj = {(r.a, r.b): r.weight for r in graph.prior_adjacency(nodes, edges).collect()}
    assert adj["q", "p"] == 1.0 and adj["p", "r"] == 0.05 and adj["r", "r"] == 1.0 and len(adj) == 9


def test_report(spark):
    w = spark.createDataFrame([(0, k, k / 10, float(k), -2.0 * k, None) for k in range(1, 11)], "recording_id long, window_id long, deviation_percentile double, a double, b double, c double")
    assert [(r.window_id, r.channel) for r in report.flagged(w, ["a", "b", "c"]).orderBy("place").collect()] == [(10, "b"), (10, "a")]
    lanes, fits = spark.createDataFrame([(0,), (1,), (2,)], "recording_id long"), spark.createDataFrame([(0, 0.5), (1, 0.95)], "recording_id long, ratio double")
    assert {r.recording_id: r.shown for r in report.lane_gate(lanes, fits).collect()} == {0: True, 1: False, 2: False}


def test_latents(spark):
    d = spark.createDataFrame([(0, 100.0, [1.0, 2.0]), (0, 900.0, [3.0, 4.0]), (0, 1000.0, [float("nan"), 0.0]), (0, 1500.0, [1.0, 1.0])], "g int, center_ms double, latent array<double>")
    got = {r.k: (r["mean"], r.n) for r in frames.pool_latents(d, ["g"], 1000.0).collect()}
    assert got == {0: ([2.0, 3.0], 2), 1: (None, 0)}
    v = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 0.0]), (0, 2, [1.0, 1.0])], "g int, i int, v array<double>")
    assert [r.step for r in frames.cosine_velocity(v, ["g"], "i", "v").orderBy("i").collect()] == [None, 1.0, 1.0]


def test_empty_windows_and_gaps(spark):
    f = [(0, 0, t, 1.0, 0.1, "A", 0, 1.0) for t in (0.0, 100.0, 5500.0)]
    cols = "recording_id long, file_index long, timestamp double, joint_confidence double, x double, emotion_label string, is_blinking int, is_audio_active double"
    s = windows.Sliding(channels=("x",))
    got = windows.window_table(spark.createDataFrame(f, cols), s).orderBy("window_id").collect()
    assert [r.window_id for r in got] == list(range(6)) and [r.frame_count for r in got] == [2, 0, 0, 0, 1, 1] and got[0].emotion_label_mode == "N/A"
    assert windows.window_table(spark.createDataFrame([], cols), s).count() == 0


def test_timestamps_are_utc(spark):
    assert spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz").select(F.unix_micros(F.col("t").cast("timestamp"))).first()[0] == 1704067200000000

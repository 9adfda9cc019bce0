import numpy as np
import pytest
from pyspark.sql import functions as F

from brolga.operators import graph


def test_masks_by_node(spark):
    rows = [(0, 0, 0, 1.0, 2.0, 3.0, 1.0, 0.5), (0, 0, 1, 2.0, 4.0, None, 0.0, 0.2), (0, 0, 2, 3.0, None, 5.0, None, None), (0, 0, 3, 4.0, 6.0, 7.0, 1.0, 0.3)]
    d = spark.createDataFrame(rows, "recording_id int, file_index int, idx int, face double, voice double, body double, is_audio_active double, face_confidence double")
    got = {(r.channel, r.idx): (r.valid, round(r.z, 6)) for r in graph.standardised(d, ["face", "voice", "body"], ("voice",), ("face",)).collect()}
    assert [got["face", k][0] for k in range(4)] == [1, 0, 0, 1] and [got["voice", k][0] for k in range(4)] == [1, 0, 0, 1] and [got["body", k][0] for k in range(4)] == [1, 0, 1, 1]
    face = np.array([1.0, 2, 3, 4])
    assert got["face", 3][1] == round((4 - face.mean()) / face.std(ddof=1), 6) and got["face", 1] == (0, 0.0)
    plain = graph.standardised(d.drop("is_audio_active", "face_confidence"), ["face", "voice"], ("voice",), ("face",)).collect()
    assert sum(r.valid for r in plain) == 7


def test_a_frame_without_a_valid_target_weighs_nothing(spark):
    e = spark.createDataFrame([(0, 4.0, 1, 1.0), (0, 0.0, 0, 3.0)], "g int, error double, n long, w double")
    assert graph.weighted_loss(e, ["g"], "w").first().loss == 1.0 and graph.weighted_loss(e, ["g"], "w", target=True).first().loss == 4.0


def test_too_few_windows(spark):
    w = spark.createDataFrame([(0, k) for k in range(25)] + [(1, k) for k in range(19)], "file_index int, window int")
    graph.check_windows(w.where("file_index = 0"), ["file_index"])
    with pytest.raises(graph.TooFewWindows, match="file_index 1: 19"):
        graph.check_windows(w, ["file_index"])
    with pytest.raises(graph.TooFewWindows):
        graph.check_windows(w.limit(0), ["file_index"])


def test_models_of_each_group_from_one_pass(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 4)) @ rnd.normal(size=(4, 4)) + 5
    g = rnd.integers(0, 3, 300)
    rows = [(int(k) if k else None, *map(float, v), 2.5) for k, v in zip(g, x)] + [(1, 1.0, None, 1.0, 1.0, 2.5), (9, None, 1.0, 1.0, 1.0, 2.5), (1, float("nan"), 1.0, 1.0, 1.0, 2.5)]
    d = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, same double").repartition(5)
    names = ["a", "b", "c", "d", "same"]
    got = {(r.g, r.channel, r.neighbour): r.weight for r in graph.neighbour_models(d, names, ["g"], reg=0.3).collect()}
    assert {k[0] for k in got} == {None, 1, 2} and len(got) == 3 * 25
    for k in (0, 1, 2):
        own = x[g == k]
        z, sd = (own - own.mean(0)) / own.std(0), own.std(0)
        for t, name in enumerate("abcd"):
            rest = [j for j in range(4) if j != t]
            beta = np.linalg.solve(z[:, rest].T @ z[:, rest] / len(z) + 0.3 * np.eye(3), z[:, rest].T @ z[:, t] / len(z)) * sd[t] / sd[rest]
            assert np.allclose([got[k or None, name, "abcd"[j]] for j in rest], beta)
            assert abs(got[k or None, name, "(intercept)"] - (own.mean(0)[t] - beta @ own.mean(0)[rest])) < 1e-9 and got[k or None, name, "same"] == 0
    models = graph.neighbour_models(d.where("g = 1"), names, ["g"])
    told = graph.predicted(d.where("g = 1"), models, names, ["g"])
    err = told.where("predicted_a is not null and not isnan(a)").agg(F.avg((F.col("predicted_a") - F.col("a")) ** 2), F.var_pop("a")).first()
    assert err[0] < err[1] and told.where("b is null and predicted_a is not null").count() == 0


def test_residuals_by_subject(spark):
    e = spark.createDataFrame([("s", k, "x", float(k)) for k in range(4)] + [("t", k, "x", 10.0 + k) for k in range(4)], "subject string, w int, node string, error double")
    got = {(r.subject, r.w): r.global_z for r in graph.residual_table(e, e, ["w"], ["subject"]).collect()}
    assert got["s", 0] == pytest.approx(got["t", 0]) and got["s", 3] > 1

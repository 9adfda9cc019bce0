import json
import shutil
import tempfile
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brolga.operators import enroll
from brolga.operators.enroll import CAPTURED
from brolga.sources import io
from brolga.streaming import jobs


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_frames_come_in_clean(spark, folder):
    (folder / "f.csv").write_text(",".join(f.name for f in io.FRAME) + "\n0,1,0.0,1.0,NaN,0.1,0.2,0.3,1,2,3,1,0,N/A\n0,1,33.3,1.0,2.0,0.1,0.2,0.3,1,2,3,1,0,A\n")
    got = io.read_frames(spark, str(folder / "f.csv"), "csv").orderBy("timestamp").collect()
    assert got[0].macro_motion_energy is None and got[0].emotion_label is None and got[1].emotion_label == "A"


def test_window_round_trip(spark, folder):
    d = spark.createDataFrame([(0, 1, 0, float("nan"), "N/A"), (0, 2, 0, 1.5, "x")], "recording_id long, file_index long, window_id long, a double, label string")
    for fmt in ("csv", "parquet"):
        io.write_windows(d, str(folder / fmt), fmt)
        part = d.select("window_id", "a", "label", "recording_id", "file_index").schema
        got = sorted(map(tuple, io.read_windows(spark, str(folder / fmt), part, fmt).select(d.columns).collect()), key=str)
        assert got == [(0, 1, 0, None, None), (0, 2, 0, 1.5, "x")]


def test_stats_round_trip(spark):
    s = spark.createDataFrame([(0, "a", 1.5, None), (0, "b", 2.0, 0.5)], "recording_id long, channel string, mean double, std double")
    j = io.stats_to_json(s)
    assert json.loads(j.first().json)["a"] == {"mean": 1.5, "std": None}
    assert sorted(map(tuple, io.stats_from_json(j).collect())) == [(0, "a", 1.5, None), (0, "b", 2.0, 0.5)]


def test_phases_segments_clicks_manifest(spark, folder):
    (folder / "p.json").write_text('[{"start_ms": 5, "end_ms": 9, "phase_label": "x"}, {}]')
    assert sorted(map(tuple, io.read_phases(spark, str(folder / "p.json")).collect())) == [(0, 0, "N/A", -1), (5, 9, "x", -1)]
    (folder / "s.json").write_text('{"schema": "v1", "files": [{"file_index": 0, "source_file": "a", "file_offset_ms": 100}], "clean_segments": [{"file_index": 0, "start_local_ms": 1, "end_local_ms": 2}]}')
    assert io.read_segments(spark, str(folder / "s.json"), "v1").first().file_offset_ms == 100
    with pytest.raises(io.SourceError):
        io.read_segments(spark, str(folder / "s.json"), "v2")
    (folder / "c.json").write_text('[{"pts_ms": 12, "kind": "seed"}]')
    assert io.read_clicks(spark, str(folder / "c.json")).first().pts_ms == 12
    (folder / "d.json").write_text('[{"pts_ms": 1.5}]')
    with pytest.raises(io.SourceError):
        io.read_clicks(spark, str(folder / "d.json"))
    (folder / "m.json").write_text('{"subjects": [{"name": "A", "clips": 3}]}')
    assert tuple(io.read_manifest(spark, str(folder / "m.json"), "subjects", "name string, clips int").first()) == ("A", 3)


def test_annotations(spark, folder):
    (folder / "a.eaf").write_text(
        '<D><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="from" TIME_VALUE="1230"/><TIME_SLOT TIME_SLOT_ID="until" TIME_VALUE="4560"/></TIME_ORDER><TIER><ANNOTATION>'
        '<ALIGNABLE_ANNOTATION ANNOTATION_ID="a7" TIME_SLOT_REF1="from" TIME_SLOT_REF2="until"><ANNOTATION_VALUE> Calm </ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></D>'
    )
    assert [tuple(r) for r in io.read_annotations(spark, str(folder / "a.eaf")).select("ordinal", "label", "start_ms", "end_ms").collect()] == [(7, "Calm", 1230, 4560)]


def test_labels_log_lists_and_listing(spark, folder):
    (folder / "l.csv").write_text("Tier,Begin Time,End Time,Value\nx,1,2, Lie \nx,oops,2,Truth\n")
    assert [tuple(r) for r in io.read_labels(spark, str(folder / "l.csv")).collect()] == [(1, 2, "lie")]
    (folder / "a.jsonl").write_text('{"seq": 0, "operation": "x"}\n\n{"seq": 1}\n')
    assert io.read_log(spark, str(folder / "a.jsonl")).count() == 2
    for text in ("\n", "nope\n"):
        (folder / "b.jsonl").write_text(text)
        with pytest.raises(io.SourceError):
            io.read_log(spark, str(folder / "b.jsonl"))
    d = spark.createDataFrame([("[1, 2.5]",), (None,)], "au string")
    assert [tuple(r) for r in io.split_list_column(d, "au", 2, "AU").collect()] == [(1.0, 2.5), (None, None)]
    (folder / "pkg").mkdir()
    (folder / "pkg" / "rec_003_x.MP4").write_text("x")
    assert [tuple(r)[1:] for r in io.list_package(spark, str(folder / "pkg")).collect()] == [("mp4", 3)]


def test_operator_clicks(spark, folder):
    good = {"speaking_click": {"file_index": 0, "pts_ms": 5, "x": 1, "y": 2.5}, "speaking_clicks": [{"file_index": 1, "pts_ms": 7, "x": 1.0, "y": 2}], "anti_click": None, "target_bearded": True, "more": [1]}
    (folder / "c.json").write_text(json.dumps(good, indent=2))
    got = io.read_operator_clicks(spark, str(folder / "c.json")).drop("file").collect()
    assert sorted(map(tuple, got)) == [("extra", 0, 1, 7, 1.0, 2.0, True, False), ("speaking", 0, 0, 5, 1.0, 2.5, True, False)]
    click = good["speaking_click"]
    for odd in ("{", {}, {"speaking_click": None}, {"speaking_click": {**click, "pts_ms": True}}, {"speaking_click": {**click, "pts_ms": 5.5}}, {"speaking_click": {**click, "file_index": "0"}}, {**good, "target_bearded": 1}, {**good, "anti_click": {"x": 1}}, {**good, "speaking_clicks": [{}]}):
        text = odd if isinstance(odd, str) else json.dumps(odd)
        with pytest.raises(io.SourceError):
            io.parse_clicks(spark.createDataFrame([(text,)], "value string"))
    (folder / "s.jsonl").write_text('{"schema": "a", "seq": 0}\n{"schema": "b", "seq": 1}\n')
    with pytest.raises(io.SourceError, match="'b'"):
        io.read_log(spark, str(folder / "s.jsonl"), "seq long", "a")


def test_results(spark, folder):
    d = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "file_index long, n long, x string")
    io.write_results(d, str(folder / "r"), ["n", "x"], ["file_index"])
    assert [x.x for x in spark.read.json(str(folder / "r")).first()["items"]] == ["a", "b"]
    io.write_table(d, str(folder / "t"), ["n"])
    assert [r.x for r in spark.read.csv(str(folder / "t"), header=True).collect()] == ["a", "b"]


def test_ledger_and_intake(spark, folder):
    (folder / "in").mkdir()
    at = datetime(2024, 1, 1)
    put = lambda name, s, state, k: (folder / "in" / f"{name}.json").write_text(json.dumps({"session_id": s, "state": state, "updated_at": (at + timedelta(hours=k)).isoformat()}))
    put("a", "one", "queued", 0)
    put("b", "two", "queued", 0)

    def run():
        q = jobs.keep_ledger(jobs.intake(spark, str(folder / "in")), str(folder / "ledger"), str(folder / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        last = max((folder / "ledger").glob("v=*"), key=lambda p: int(p.name[2:]))
        return sorted((r.session_id, r.state) for r in spark.read.parquet(str(last)).collect())

    assert run() == [("one", "queued"), ("two", "queued")]
    put("c", "one", "completed", 1)
    assert run() == [("one", "completed"), ("two", "queued")]
    put("d", "one", "queued", 2)
    put("e", "two", "active", 3)
    assert run() == [("one", "completed"), ("two", "active")]


def _stream(spark, folder, df, n):
    path = str(folder / f"s{n}")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drain(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_changes(spark, folder):
    at = datetime(2024, 1, 1)
    rows = [("a", s, at + timedelta(seconds=k)) for k, s in enumerate(["q", "q", "x", "x", "q"])]
    _drain(jobs.changes(_stream(spark, folder, spark.createDataFrame(rows, jobs.PROFILE), 0), None), "changed")
    assert [r.state for r in spark.table("changed").orderBy("updated_at").collect()] == ["q", "x", "q"]


def test_stream_captures_as_the_batch_does(spark, folder):
    cols = "file_index long, t_ms long, here boolean, turned boolean, mar double, other_here boolean, other_mar double, speech boolean"
    rows = [(f, 100 * k, True, k % 11 == 5, 0.2 + 0.01 * f, k % 17 == 3, 0.3, (k // 12 + f) % 2 == 0) for f in range(3) for k in range(80)]
    batch = spark.createDataFrame(rows, cols)
    want = sorted(map(tuple, enroll.capture_windows(batch).collect()))
    ends = spark.createDataFrame([(f, None, None, None, None, None, None, None) for f in range(3)], cols)
    _drain(jobs.capture_stream(_stream(spark, folder, batch.union(ends).coalesce(1), 1), None), "captured")
    assert want and sorted(map(tuple, spark.table("captured").collect())) == want


def test_sliding_stream(spark, folder):
    at = datetime(2024, 1, 1)
    rows = [(0, at + timedelta(milliseconds=500 * k), 0.5, float(k)) for k in range(8)] + [(0, at + timedelta(hours=1), 1.0, 0.0)]
    d = spark.createDataFrame(rows, "file_index long, ts timestamp, joint_confidence double, value double")
    _drain(jobs.sliding(_stream(spark, folder, d, 2)), "slid")
    got = {r.start - at: (r.frame_count, r["mean"]) for r in spark.table("slid").where(F.col("start") >= at).collect()}
    assert got[timedelta(0)] == (4, 1.5) and got[timedelta(seconds=1)] == (4, 3.5)


def _until(enough, limit=60):
    end = time.time() + limit
    while not enough() and time.time() < end:
        time.sleep(0.5)
    return enough()


def test_silent_files_are_closed_and_a_restart_goes_on(spark, folder):
    cols = "file_index long, t_ms long, here boolean, turned boolean, mar double, other_here boolean, other_mar double, speech boolean"
    rows = [(f, 100 * k, True, False, 0.3, False, None, (k // 12 + f) % 2 == 0) for f in range(2) for k in range(60)]
    whole = spark.createDataFrame(rows, cols)
    want = sorted(map(tuple, enroll.capture_windows(whole).collect()))
    path, out = str(folder / "seen"), str(folder / "out")

    def start():
        stream = spark.readStream.schema(whole.schema).parquet(path)
        return jobs.capture_stream(stream, 20_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "cp2")).start()

    got = lambda: sorted(map(tuple, spark.read.schema(CAPTURED).parquet(out).collect())) if list((folder / "out").glob("*.parquet")) else []
    whole.where("t_ms < 3000").coalesce(1).write.parquet(path)
    query = start()
    assert _until(lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 0)
    query.stop()
    whole.where("t_ms >= 3000").coalesce(1).write.mode("append").parquet(path)
    query = start()
    try:
        assert _until(lambda: len(got()) >= len(want)), query.exception()
    finally:
        query.stop()
    assert got() == want and any(r[3] == "end" for r in want)


def test_final_states_are_forgotten(spark, folder):
    at = datetime(2024, 1, 1)
    path = str(folder / "states")
    put = lambda *rows: spark.createDataFrame([(s, x, at + timedelta(hours=k)) for s, x, k in rows], jobs.PROFILE).coalesce(1).write.mode("append").parquet(path)
    put(("a", "queued", 0), ("a", "completed", 1), ("b", "queued", 0))
    told = jobs.changes(spark.readStream.schema(jobs.PROFILE).parquet(path), 1000)
    query = told.writeStream.format("memory").queryName("forgot").outputMode("append").start()
    try:
        n = lambda: spark.table("forgot").count()
        assert _until(lambda: n() == 3)
        time.sleep(3)
        put(("a", "completed", 5), ("b", "queued", 5), ("c", "queued", 5))
        assert _until(lambda: n() == 5)
    finally:
        query.stop()
    assert sorted((r.session_id, r.state) for r in spark.table("forgot").where(F.col("updated_at") > at + timedelta(hours=2)).collect()) == [("a", "completed"), ("c", "queued")]


def test_a_lost_version_raises_and_restarts_mark(spark, folder):
    at = datetime(2024, 1, 1)
    path = str(folder / "more")
    put = lambda s, k: spark.createDataFrame([(s, "queued", at + timedelta(hours=k))], jobs.PROFILE).coalesce(1).write.mode("append").parquet(path)
    run = lambda: jobs.keep_ledger(spark.readStream.schema(jobs.PROFILE).parquet(path), str(folder / "led"), str(folder / "cp3")).trigger(availableNow=True).start()
    put("a", 0)
    run().awaitTermination(60)
    shutil.move(str(folder / "led" / "v=0"), str(folder / "gone"))
    put("b", 1)
    with pytest.raises(Exception, match="which is not there"):
        run().awaitTermination(60)
    rows = [("a", "active", at), ("b", "completed", at), ("c", "interrupted", at)]
    got = jobs.mark_interrupted(spark.createDataFrame(rows, jobs.PROFILE), F.lit(at + timedelta(hours=1)).cast("timestamp")).collect()
    assert {r.session_id: (r.state, r.updated_at == at) for r in got} == {"a": ("interrupted", False), "b": ("completed", True), "c": ("interrupted", True)}

"""Faults that show only on larger tables, or with other settings of the session, on small ones."""

import re
from functools import reduce
from operator import add

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brolga.functions.exprs import nearest
from brolga.functions.vectors import cross_moments
from brolga.operators import calibrate, graph, report, windows
from brolga.plans.registry import ORACLES, QUERIES
from brolga.sources import adapters
from tests.sqlcheck import rows as told


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "331")
    yield
    spark.conf.set(key, before)


def test_moments_count_every_row_of_many_parts(spark, small_batches):
    rows = spark.range(10_000, numPartitions=1).selectExpr("pmod(xxhash64(id), 7) as g", "id % 13 / 3D as a", "id % 17 / 7D as b")
    got = {r.g: r.n for r in cross_moments(rows, ["g"], ["a", "b"]).collect()}
    assert got == {r.g: r["count"] for r in rows.groupBy("g").count().collect()}


def test_magnitudes_equal_but_for_rounding_tie(spark):
    rows = spark.createDataFrame([(0, 1, k, k * 1.0, k + 2.0, x) for k, x in enumerate([1.0, 0.1 + 0.2, 0.3, 2.0])], "recording_id long, file_index long, window_id long, start_time_ms double, end_time_ms double, deviation_magnitude double")
    offsets = spark.createDataFrame([(0, 1, 0.0)], "recording_id long, file_index long, file_offset_ms double")
    got = {r.clip_window_id: r.deviation_percentile for r in calibrate.assemble(rows, offsets).collect()}
    assert got == {0: 3 / 4, 1: 1.5 / 4, 2: 1.5 / 4, 3: 1.0}


def test_channels_equal_but_for_rounding_go_by_name(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 0.3, 0.1 + 0.2)], "recording_id long, window_id long, deviation_percentile double, a double, b double")
    assert [r.channel for r in report.flagged(rows, ["a", "b"], top=1).collect()] == ["a"]


@pytest.mark.parametrize("name", ["clean_segments", "clean_segment_totals"])
def test_an_overlap_inside_a_run_parts_it(spark, tmp_path, name):
    """Short turns, so that overlap regions end within runs of HIGH blocks."""
    db = duckdb.connect()
    db.execute("create table conversations as select c as conv_id, t as turn, 'user' as role, repeat('x', ((c * 17 + t * 29 + c * t * 7) % 60)::int) as text from range(80) a(c), range(14) b(t)")
    db.execute(f"copy conversations to '{tmp_path}/conversations.parquet'")
    got, want = told(QUERIES[name](spark, str(tmp_path)).toPandas()), told(db.execute(ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", ["window_plan", "clean_segment_totals", "bridged_segments"])
def test_cut_spans_are_not_sent_through_the_driver(spark, sf, name):
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_clip_are_dealt_once(spark, sf):
    plan = QUERIES["within_clip"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan


def test_turns_are_dealt_in_parts_of_their_own_before_they_are_cut(spark, sf):
    for name in ("block_tiers", "tier_reasons", "stitched_chunks"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def _largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_parts_of_a_table_do_not_grow_with_it(spark, tmp_path):
    """Files of under 4 MB, which Spark reads in as many parts whatever they hold."""
    for n in (20_000, 80_000):
        turns = spark.range(n, numPartitions=2).selectExpr("id div 5 as conv_id", "id % 5 as turn", "'user' as role", "repeat('x', 40) as text")
        turns.write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        assert _largest(adapters.intervals(spark, f"{tmp_path}/{n}")) < 1.5 * adapters.PART_TURNS


def test_rows_are_dealt_from_small_parts_of_a_file(spark, sf):
    """A task that deals its rows to many parts holds all it has read."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for given, then in (("134217728b", "24m"), ("1g", "24m"), ("16m", "16m"), ("4194304", "4194304")):
        spark.conf.set(key, given)
        adapters.frames(spark, sf)
        assert spark.conf.get(key) == then
    spark.conf.set(key, before)


def test_folds_read_rows_that_were_worked_out_once(spark, sf):
    assert "lineitem" not in QUERIES["loso_flags"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def _lineitem(path, select):
    db = duckdb.connect()
    cols = "k as l_orderkey, 0::bigint as l_partkey, l_suppkey, 1 as l_linenumber, l_quantity, 1000e0 + k as l_extendedprice, l_discount, 0.04e0 as l_tax, 'A' as l_returnflag"
    db.execute(f"create table lineitem as select {cols} from ({select})")
    db.execute(f"copy lineitem to '{path}/lineitem.parquet'")
    return db


def test_a_window_at_the_least_weight_but_for_rounding_counts(spark, tmp_path):
    """25 frames of weight 0.6 in sum, in any order: 14.999999999999995 in turn."""
    db = _lineitem(tmp_path, "select k, 3::bigint as l_suppkey, 10e0 + k % 5 as l_quantity, 0.05e0 as l_discount from range(25) a(k)")
    found = QUERIES["self_calibrated"](spark, str(tmp_path)).toPandas()
    assert told(found) == told(db.execute(ORACLES["self_calibrated"]).df())
    assert found.AU12_mean.tolist() == [pytest.approx(0.24)]


def test_a_start_that_varies_by_rounding_only_does_not_vary(spark, tmp_path):
    db = _lineitem(tmp_path, "select k, 3::bigint as l_suppkey, case when k < 290 then 19e0 else k % 50 + 0e0 end as l_quantity, (3 + k * k % 7) / 100e0 as l_discount from range(600) a(k)")
    found = QUERIES["self_calibrated"](spark, str(tmp_path)).toPandas()
    assert told(found) == told(db.execute(ORACLES["self_calibrated"]).df())
    assert found.AU12_mean.isna().all() and found.gaze_x_mean.isna().all()


@pytest.mark.parametrize("name", ["zero_reference", "residual_attribution", "model_windows"])
def test_frames_are_not_dealt_again_by_channel(spark, sf, name):
    """What holds a row for each frame stays where its clip is: its statistics come to it, and its channels become rows there."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "Expand" not in plan and not any("idx#" in line or "value#" in line for line in dealt)


def test_errors_of_single_values_are_not_grouped(spark, sf):
    """A row for each value is no group of its own; and the first clip is found by what tells the clips, frames are not dealt for it."""
    rows = spark.createDataFrame([(1, 0.5, 2.0), (1, None, 2.0), (0, 0.5, 2.0), (None, 0.5, 2.0), (1, 3.0, 3.0)], "valid int, z double, predicted double").withColumn("id", F.monotonically_increasing_id())
    own, grouped = (sorted((r.id, r.error, r.n) for r in df.collect()) for df in (graph.masked_error(rows), graph.masked_error(rows, ["id"])))
    assert own == grouped and [x[1:] for x in own] == [(2.25, 1), (0.0, 0), (0.0, 0), (0.0, 0), (0.0, 1)]
    plan = QUERIES["residual_attribution"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate(keys=" in line and "idx#" in line.split("functions=")[0] for line in plan.splitlines())
    assert len(set(re.findall(r"FileScan parquet (\[.*?\])", re.sub(r"#\d+L?", "", plan)))) == 3  # for windows, statistics and clips


def test_first_clip_of_a_recording_is_the_baseline(spark, tmp_path):
    """Also with clips of one window, one frame, and a recording of one clip; clips without a number are in none."""
    db = _lineitem(tmp_path, "select k, case when k % 97 = 0 then null when k < 300 then 23 when k < 480 then 3 when k = 480 then 13 when k < 700 then 14 else 4 end::bigint as l_suppkey, k * k % 50 + 0e0 as l_quantity, (3 + k * k % 7) / 100e0 as l_discount from range(900) a(k)")
    found = QUERIES["residual_attribution"](spark, str(tmp_path)).toPandas()
    assert told(found) == told(db.execute(ORACLES["residual_attribution"]).df()) and sorted(set(found.file_index)) == [3, 4, 13, 14, 23]


def test_windows_of_one_length_are_transformed_together(spark):
    """As often as there are lengths, not windows; each as if it were alone, gaps included."""
    rng = np.random.default_rng(42)
    x = rng.normal(size=(40, 120))
    x[rng.random(x.shape) < np.linspace(0, 0.6, 40)[:, None]] = np.nan
    x[3, 50:80], x[4], x[5, :30], x[6, 40:], x[7] = np.nan, 1.0, np.nan, np.nan, np.nan
    alone = np.vstack([windows.band_rows(v[None]) for v in x])
    assert np.allclose(windows.band_rows(x), alone, equal_nan=True) and 0 < np.isnan(alone[:, 0]).sum() < 40
    assert all(np.array_equal(a, windows.fill_gaps(v), equal_nan=True) for a, v in zip(windows.fill_gaps(x), x, strict=True))
    told = windows.spectra(spark.range(3000).selectExpr("1L as recording_id", "2L as file_index", "id * 1000D / 30 as timestamp", "sin(id) as gaze_x"), ("gaze_x",)).toPandas()
    assert len(told) == 100 and told.window_id.tolist() == list(range(100)) and told.gaze_x_tremor_peak.notna().all()


def test_files_of_a_session_pass_in_batches(spark, sf, small_batches):
    """A batch boundary inside a session changes nothing, and no session is handed to Python as a whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    query = QUERIES["enrolled_files"](spark, sf)
    cut = told(query.toPandas())
    assert "FlatMapGroups" not in query._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(cut[1]) > 12 and cut == told(QUERIES["enrolled_files"](spark, sf).toPandas())


def test_counts_of_values_are_worked_out_once(spark, sf):
    """Branches of the plan that use the percentiles of clips are the same, so Spark keeps one of them."""
    plan = QUERIES["subject_scores"](spark, sf)
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Window [rank(") == 1


@pytest.fixture
def light_end(tmp_path):
    """Two clips of a recording; the last window of the second has other values, and 25 frames of weight 0.6: in order of time
    they add up to 14.999999999999995."""
    db = duckdb.connect()
    last = lambda then, other: f"case when c = 1 and k >= 570 then {then} else {other} end"
    db.execute(f"""create table lineitem as select k as l_orderkey, 0::bigint as l_partkey, 3 + c * 10 as l_suppkey, (1 + k % 7)::int as l_linenumber, {last("49e0", "k * k % 50 + 0e0")} as l_quantity,
      {last("90000e0", "1000e0 + k * 37 % 900")} as l_extendedprice, {last("0.05e0", "(3 + k * k % 7) / 100e0")} as l_discount, {last("0.08e0", "k * k * k % 8 / 100e0")} as l_tax, substr('ANR', (1 + k % 3)::int, 1) as l_returnflag
      from range(2) a(c), range(595) b(k)""")
    db.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    return str(tmp_path), db


@pytest.mark.parametrize("name", ["recording_percentiles", "window_features", "window_indices", "full_windows", "flagged_windows", "deviation_ratio"])
def test_weights_are_compared_as_in_the_sql(spark, light_end, name):
    sf, db = light_end
    assert told(QUERIES[name](spark, sf).toPandas()) == told(db.execute(ORACLES[name]).df())


def test_weights_are_added_in_order_of_time(spark):
    """In whatever order frames come, 14.999999999999995 and 15."""
    cols = "recording_id long, file_index long, timestamp double, joint_confidence double, x double, emotion_label string, is_blinking int, is_audio_active double"
    for weights, heavy in (([0.6] * 25, False), ([0.6, 0.72, 1.0, 0.96, 0.12, 0.84, 0.6, 0.72, 0.6, 0.96, 0.12, 1.0, 0.36, 0.96, 1.0, 0.36, 0.72, 0.36, 0.84, 0.72, 0.48, 0.96], True)):
        f = [(0, 0, k * 1000 / 30, w, 0.1, "A", 0, 1.0) for k, w in enumerate(weights)]
        for given in (f, f[::-1], f[1::2] + f[::2]):
            (got,) = windows.window_table(spark.createDataFrame(given, cols).coalesce(1), windows.Sliding(channels=("x",))).collect()
            assert got.cumulative_confidence == reduce(add, weights) and (got.x_mean is not None) == heavy
        assert windows.window_table(spark.createDataFrame(f, cols), windows.Sliding(channels=("x",), digits=9)).first().x_mean is not None


def exactly(df):
    """Rows in any order, numbers to their last digit."""
    return sorted("|".join(repr(v + 0.0) if isinstance(v, float) else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def test_halves_but_for_rounding_are_rounded_as_in_sql(spark, tmp_path):
    x = [s * (k + 0.5) / 10.0**d for d in (6, 9) for k in range(0, 10**6, 997) for s in (1, -1)] + [0.0, -0.0, 1e300, -1e300, 1e-300, 4.5e15, float("inf"), float("nan"), None]
    spark.createDataFrame([(v,) for v in x], "x double").write.parquet(f"{tmp_path}/x")
    for d in (6, 9):
        found = spark.read.parquet(f"{tmp_path}/x").select("x", (nearest(F.col("x"), d) + 0.0).alias("r"))
        assert exactly(found.toPandas()) == exactly(duckdb.sql(f"select x, round(x, {d}) + 0e0 as r from '{tmp_path}/x/*.parquet'").df())


@pytest.fixture
def halves(tmp_path):
    """A clip of one window for each of 60 means of AU12 that are a half in the seventh or the tenth digit, but for rounding."""
    db = duckdb.connect()
    db.execute("""create table lineitem as select k as l_orderkey, 0::bigint as l_partkey, c as l_suppkey, (1 + k % 7)::int as l_linenumber, 50 * (0.5e0 + (c * 77777 + 0.5e0) / case when c < 10 then 1e6 else 1e9 end) as l_quantity,
      1000e0 + k * 37 % 900 as l_extendedprice, 0.1e0 as l_discount, k * k * k % 8 / 100e0 as l_tax, substr('ANR', (1 + k % 3)::int, 1) as l_returnflag from range(60) a(c), range(20) b(k)""")
    db.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    return str(tmp_path), db


@pytest.mark.parametrize("name", ["window_features", "window_indices", "full_windows"])
def test_window_means_are_rounded_as_in_the_sql(spark, halves, name):
    sf, db = halves
    assert exactly(QUERIES[name](spark, sf).toPandas()) == exactly(db.execute(ORACLES[name]).df())


def test_magnitudes_are_ranked_by_the_digits_of_the_sql(spark):
    """0.5192125 is less than a half in the seventh digit, so it ties with 0.519212."""
    rows = spark.createDataFrame([(0, 1, k, k * 1.0, k + 2.0, x) for k, x in enumerate([0.519212, 0.5192125, 0.519213])], "recording_id long, file_index long, window_id long, start_time_ms double, end_time_ms double, deviation_magnitude double")
    offsets = spark.createDataFrame([(0, 1, 0.0)], "recording_id long, file_index long, file_offset_ms double")
    got = {r.clip_window_id: r.deviation_percentile for r in calibrate.assemble(rows, offsets).collect()}
    assert got == {0: 1.5 / 3, 1: 1.5 / 3, 2: 1.0} and duckdb.sql("select round(0.5192125e0, 6)").fetchall() == [(0.519212,)]
    rows = spark.createDataFrame([(0, 0, 1.0, 0.5192125, 0.519213, 0.519212)], "recording_id long, window_id long, deviation_percentile double, c double, b double, d double")
    assert [r.channel for r in report.flagged(rows, ["b", "c", "d"], top=3).orderBy("place").collect()] == ["b", "c", "d"]

"""Queries that write given rows as the files of a session, as other programs leave them, and read them by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from brolga.plans.common import INTERVALS
from brolga.sources import io
from brolga.sources.adapters import intervals, table
from brolga.streaming.jobs import shared_dir

DOCS = 8


def _documents(spark, rows):
    """One file for each row (doc, value)."""
    path = shared_dir(spark)
    rows.repartition("doc").write.partitionBy("doc").text(path)
    return path


def _turns(spark, d):
    return intervals(spark, d).withColumn("doc", F.col("file_index") % DOCS)


def phase_files(spark, d):
    """Turns as phase manifests, JSON lists; every fifth has no label, every seventh no question."""
    one = F.struct("start_ms", "end_ms", F.when(F.col("start_ms") % 5 != 0, F.col("label")).alias("phase_label"), F.when(F.col("turn") % 7 != 0, F.col("turn").cast("int")).alias("question_id"))
    docs = _turns(spark, d).groupBy("doc").agg(F.to_json(F.collect_list(one)).alias("value"))
    return io.read_phases(spark, _documents(spark, docs)).groupBy("start_ms", "end_ms", "phase_label", "question_id").agg(F.count("*").alias("n"))


PHASES = f"""with {INTERVALS} select start_ms, end_ms, case when start_ms % 5 <> 0 then label else 'N/A' end as phase_label, coalesce(case when turn % 7 <> 0 then turn end, -1)::int as question_id, count(*) as n from intervals group by all"""


def annotation_files(spark, d):
    """Turns as annotation files: time slots, and annotations that refer to them."""
    n = (F.col("file_index") * 100 + F.col("turn")).cast("string")
    slot = lambda k, at: F.concat(F.lit(f'<TIME_SLOT TIME_SLOT_ID="{k}'), n, F.lit('" TIME_VALUE="'), F.col(at).cast("string"), F.lit('"/>'))
    note = F.concat(F.lit('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a'), n, F.lit('" TIME_SLOT_REF1="s'), n, F.lit('" TIME_SLOT_REF2="e'), n, F.lit('"><ANNOTATION_VALUE> '), F.col("label"), F.lit(" </ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>"))
    join = lambda c: F.array_join(F.collect_list(c), "\n")
    docs = _turns(spark, d).groupBy("doc").agg(F.concat(F.lit("<D>\n<TIME_ORDER>\n"), join(F.concat(slot("s", "start_ms"), F.lit("\n"), slot("e", "end_ms"))), F.lit("\n</TIME_ORDER>\n<TIER>\n"), join(note), F.lit("\n</TIER>\n</D>")).alias("value"))
    return io.read_annotations(spark, _documents(spark, docs)).select("ordinal", "label", "start_ms", "end_ms")


ANNOTATIONS = f"""with {INTERVALS} select (file_index * 100 + turn)::int as ordinal, label, start_ms, end_ms from intervals"""


def label_files(spark, d):
    """Turns as a delimited file with headers of its own; every ninth has no end and is left out."""
    path = shared_dir(spark)
    rows = intervals(spark, d).select(F.col("file_index").alias("Tier"), F.col("start_ms").cast("double").alias("Begin Time - msec"), F.when(F.col("turn") % 9 != 4, F.col("end_ms").cast("string")).otherwise("open").alias("Stop Time"), F.concat(F.lit(" "), F.upper("label")).alias("Annotation"))
    rows.write.option("header", True).csv(path)
    return io.read_labels(spark, path).groupBy("start_ms", "end_ms", "label").agg(F.count("*").alias("n"))


LABELS = f"""with {INTERVALS} select start_ms, end_ms, label, count(*) as n from intervals where turn % 9 <> 4 group by all"""


def segment_files(spark, d):
    """Turns as clean segments of a session's files, with the offsets of those."""
    rows = _turns(spark, d)
    files = F.sort_array(F.collect_set(F.struct("file_index", F.concat(F.lit("f"), F.col("file_index")).alias("source_file"), (F.col("file_index") * 1000).alias("file_offset_ms"))))
    segs = F.collect_list(F.struct("file_index", F.col("start_ms").alias("start_local_ms"), F.col("end_ms").alias("end_local_ms"), (F.col("start_ms") + F.col("file_index") * 1000).alias("start_global_ms"), (F.col("end_ms") + F.col("file_index") * 1000).alias("end_global_ms")))
    docs = rows.groupBy("doc").agg(F.to_json(F.struct(F.lit("clean-1").alias("schema"), files.alias("files"), segs.alias("clean_segments"))).alias("value"))
    return io.read_segments(spark, _documents(spark, docs), "clean-1").select("file_index", "source_file", "file_offset_ms", "start_local_ms", "end_global_ms")


SEGMENTS = f"""with {INTERVALS} select file_index, 'f' || file_index as source_file, file_index * 1000 as file_offset_ms, start_ms as start_local_ms, end_ms + file_index * 1000 as end_global_ms from intervals"""


def log_files(spark, d):
    """Orders as entries of an audit log, JSON lines with blank ones between."""
    path = shared_dir(spark)
    o = table(spark, d, "orders")
    line = F.to_json(F.struct(F.lit("log-1").alias("schema"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("operation"), F.to_json(F.struct(F.col("o_orderpriority").alias("p"))).alias("payload")))
    o.select(F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))).alias("value")).write.text(path)
    return io.read_log(spark, path, "seq long, operation string, payload string", "log-1")


LOG = """select o_orderkey as seq, o_orderstatus as operation, '{"p":"' || o_orderpriority || '"}' as payload from orders"""


def click_files(spark, d):
    """Conversations as click documents: a speaking click each, some extra ones, an anti click or none, flags or none."""
    path = shared_dir(spark)
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    click = lambda k: F.struct(F.col("conv_id").alias("file_index"), (F.col("n") * 1000 + k).alias("pts_ms"), (F.col("conv_id") % 640 + k).cast("double").alias("x"), F.lit(k).alias("y"))
    doc = F.struct(
        F.col("conv_id"), click(0).alias("speaking_click"), F.when(F.col("n") > 3, F.array(click(1), click(2))).alias("speaking_clicks"),
        F.when(F.col("n") % 2 == 0, click(9)).alias("anti_click"), F.when(F.col("n") % 3 == 0, F.col("n") > 4).alias("target_bearded"),
    )
    rows.select(F.to_json(doc).alias("value")).write.text(path)
    docs = spark.read.text(path).select(F.get_json_object("value", "$.conv_id").cast("long").alias("conv_id"), "value")
    return io.parse_clicks(docs)


CLICKS = """with c as (select conv_id, max(turn) as n from conversations group by 1), k as (select *, 'speaking' as role, 0 as place, 0 as k from c union all select *, 'extra', 0, 1 from c where n > 3 union all select *, 'extra', 1, 2 from c where n > 3 union all select *, 'anti', 0, 9 from c where n % 2 = 0)
select conv_id, role, place::int as place, conv_id as file_index, n * 1000 + k as pts_ms, (conv_id % 640 + k)::double as x, k::double as y, n % 3 = 0 and n > 4 as target_bearded, false as interviewer_bearded from k"""


def manifest_files(spark, d):
    """Nations as the subjects of manifests, one for each region."""
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("clips"))).alias("subjects"))).alias("value"))
    return io.read_manifest(spark, _documents(spark, rows), "subjects", "name string, clips long")


MANIFESTS = """select n_name as name, n_nationkey::bigint as clips from nation"""

ALL = {
    "phase_files": (phase_files, PHASES),
    "annotation_files": (annotation_files, ANNOTATIONS),
    "label_files": (label_files, LABELS),
    "segment_files": (segment_files, SEGMENTS),
    "log_files": (log_files, LOG),
    "click_files": (click_files, CLICKS),
    "manifest_files": (manifest_files, MANIFESTS),
}

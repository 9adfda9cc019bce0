"""Readers and writers of the engine's files. NaN and 'N/A' come in as nulls, every reader has a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = T.StructType(
    [T.StructField("recording_id", T.LongType()), T.StructField("file_index", T.LongType()), T.StructField("timestamp", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in ("joint_confidence", "macro_motion_energy", "gaze_x", "gaze_y", "gaze_z", "AU12", "AU6", "AU4", "is_audio_active")]
    + [T.StructField("is_blinking", T.IntegerType()), T.StructField("emotion_label", T.StringType())]
)


class SourceError(ValueError):
    """A file is not what it should be."""


def clean(df: DataFrame) -> DataFrame:
    """NaN and 'N/A' as null in all columns."""
    of = {"double": lambda c: F.when(~F.isnan(c), F.col(c)), "float": lambda c: F.when(~F.isnan(c), F.col(c)), "string": lambda c: F.when(F.col(c) != "N/A", F.col(c))}
    return df.select(*[of[t](c).alias(c) if t in of else F.col(c) for c, t in df.dtypes])


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(FRAME)
    return clean(reader.csv(path, header=True, nanValue="NaN") if fmt == "csv" else reader.parquet(path))


def write_windows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Partitioned by recording and clip."""
    writer = df.write.partitionBy("recording_id", "file_index").mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_windows(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return clean(spark.read.schema(schema).csv(path, header=True) if fmt == "csv" else spark.read.schema(schema).parquet(path))


def stats_to_json(stats: DataFrame) -> DataFrame:
    """(recording_id, json) of baseline statistics; a missing deviation is a JSON null."""
    entry = F.struct("channel", F.struct("mean", "std"))
    return stats.groupBy("recording_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry)), {"ignoreNullFields": "false"}).alias("json"))


def stats_from_json(rows: DataFrame) -> DataFrame:
    m = F.from_json("json", "map<string, struct<mean double, std double>>")
    return rows.select("recording_id", F.explode(m).alias("channel", "s")).select("recording_id", "channel", "s.mean", "s.std")


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("multiLine", True).schema("start_ms long, end_ms long, phase_label string, question_id int").json(path)
    return rows.select(
        F.coalesce("start_ms", F.lit(0)).alias("start_ms"), F.coalesce("end_ms", F.lit(0)).alias("end_ms"),
        F.coalesce("phase_label", F.lit("N/A")).alias("phase_label"), F.coalesce("question_id", F.lit(-1)).alias("question_id"),
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations (file, ordinal, label, start_ms, end_ms) of EAF files: time slots are joined to what refers to them."""
    slots = spark.read.format("xml").option("rowTag", "TIME_SLOT").schema("_TIME_SLOT_ID string, _TIME_VALUE long").load(path)
    notes = spark.read.format("xml").option("rowTag", "ALIGNABLE_ANNOTATION").schema("_ANNOTATION_ID string, _TIME_SLOT_REF1 string, _TIME_SLOT_REF2 string, ANNOTATION_VALUE string").load(path)
    slots = slots.select(F.input_file_name().alias("file"), F.col("_TIME_SLOT_ID").alias("slot"), F.col("_TIME_VALUE").alias("ms"))
    notes = notes.select(
        F.input_file_name().alias("file"),
        F.regexp_extract("_ANNOTATION_ID", r"(\d+)$", 1).try_cast("int").alias("ordinal"),
        F.trim("ANNOTATION_VALUE").alias("label"),
        F.col("_TIME_SLOT_REF1").alias("a"),
        F.col("_TIME_SLOT_REF2").alias("b"),
    )
    at = lambda ref, name: slots.select("file", F.col("slot").alias(ref), F.col("ms").alias(name))
    return notes.join(at("a", "start_ms"), ["file", "a"]).join(at("b", "end_ms"), ["file", "b"]).drop("a", "b")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels (start_ms, end_ms, label) of a delimited file whose columns are told by parts of their names, else by place."""
    head = spark.read.csv(path, header=True).columns
    low = [c.lower() for c in head]

    def named(parts: tuple[str, ...], place: int) -> str:
        return next((h for h, c in zip(head, low, strict=True) if any(p in c for p in parts)), head[min(place, len(head) - 1)])

    rows = spark.read.csv(path, header=True)
    rows = rows.select(
        F.col(f"`{named(('start', 'begin'), 0)}`").try_cast("double").cast("long").alias("start_ms"),
        F.col(f"`{named(('end', 'stop'), 1)}`").try_cast("double").cast("long").alias("end_ms"),
        F.lower(F.trim(F.col(f"`{named(('label', 'value', 'annotation'), 2)}`"))).alias("label"),
    )
    return rows.na.drop()


SEGMENTS = "schema string, files array<struct<file_index long, source_file string, file_offset_ms long>>, clean_segments array<struct<file_index long, start_local_ms long, end_local_ms long, start_global_ms long, end_global_ms long>>"


def read_segments(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """Clean segments with their file's offset; SourceError unless every document has the expected schema string."""
    docs = spark.read.option("multiLine", True).schema(SEGMENTS).json(path)
    odd = docs.where(~F.col("schema").eqNullSafe(F.lit(expected))).first()
    if odd:
        raise SourceError(f"schema {odd.schema!r} is not {expected!r}")
    files = docs.select(F.explode("files").alias("f")).select("f.file_index", "f.source_file", "f.file_offset_ms")
    segs = docs.select(F.explode("clean_segments").alias("s")).select("s.*")
    return segs.join(files, "file_index", "left")


def read_log(spark: SparkSession, path: str, schema: str = "seq long, operation string, payload string, payload_sha256 string, prev_sha256 string, entry_sha256 string", expected: str | None = None) -> DataFrame:
    """Audit entries of JSON lines; blank lines are skipped. SourceError for a line that is not JSON, an empty file, or an entry
    whose own schema string is not the expected one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value").select("r.*", "value")
    if rows.isEmpty():
        raise SourceError("the log is empty")
    bad = rows.where("_bad is not null").first()
    if bad:
        raise SourceError(f"not JSON: {bad._bad[:80]}")
    if expected is not None:
        odd = rows.select(F.get_json_object("value", "$.schema").alias("schema")).where(~F.col("schema").eqNullSafe(F.lit(expected))).first()
        if odd:
            raise SourceError(f"schema {odd.schema!r} is not {expected!r}")
    return rows.drop("_bad", "value")


_CLICKS = {"speaking": "$.speaking_click", "extra": "$.speaking_clicks", "anti": "$.anti_click"}


def parse_clicks(docs: DataFrame, text: str = "value") -> DataFrame:
    """Clicks of JSON documents as an operator leaves them: docs' other columns, role (speaking, extra or anti), place (from 0),
    file_index, pts_ms, x, y, target_bearded and interviewer_bearded.

    speaking_click is mandatory, anti_click (null or absent: none) and the list speaking_clicks are not; flags are false if absent.
    SourceError if a document is not JSON, lacks the speaking click, has a click whose file_index or pts_ms is no whole number,
    or whose x or y is no number, or a flag that is no boolean. Documents are taken apart as variants, row by row in Spark.
    """
    keep = [c for c in docs.columns if c != text]
    v = F.try_parse_json(text)
    rows = docs.select(*keep, v.alias("_v"))
    kind = lambda x: F.regexp_replace(F.schema_of_variant(x), r"DECIMAL.*", "DECIMAL")
    at = lambda x, p, t="variant": F.try_variant_get(x, p, t)
    flags = {f: at(F.col("_v"), f"$.{f}") for f in ("target_bearded", "interviewer_bearded")}
    bad = F.col("_v").isNull() | at(F.col("_v"), _CLICKS["speaking"]).isNull()
    for x in flags.values():
        bad = bad | F.coalesce(kind(x) != "BOOLEAN", F.lit(False))
    one = lambda role: F.array(F.struct(F.lit(role).alias("role"), at(F.col("_v"), _CLICKS[role]).alias("click")))
    extra = F.transform(F.coalesce(at(F.col("_v"), _CLICKS["extra"], "array<variant>"), F.array().cast("array<variant>")), lambda c: F.struct(F.lit("extra").alias("role"), c.alias("click")))
    rows = rows.select(*keep, bad.alias("_bad"), *[F.coalesce(at(F.col("_v"), f"$.{f}", "boolean"), F.lit(False)).alias(f) for f in flags], F.posexplode(F.concat(one("speaking"), extra, one("anti"))).alias("_n", "_c"))
    click = F.col("_c.click")
    there = (click.isNotNull() & ~F.is_variant_null(click)) | (F.col("_c.role") != "anti")
    rows = rows.where(there)
    whole = lambda f: F.coalesce(kind(at(click, f"$.{f}")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))
    number = lambda f: at(click, f"$.{f}", "double").isNotNull()
    wrong = rows.where(F.col("_bad") | ~whole("file_index") | ~whole("pts_ms") | ~number("x") | ~number("y")).select(*keep, "_c.role").first()
    if wrong:
        raise SourceError(f"clicks: a {wrong.role} click, or its document, is not as it must be ({', '.join(f'{c}={wrong[c]}' for c in keep)})")
    n = F.when(F.col("_c.role") == "extra", F.col("_n") - 1).otherwise(0)
    return rows.select(*keep, F.col("_c.role").alias("role"), n.alias("place"), *[at(click, f"$.{f}", t).alias(f) for f, t in (("file_index", "long"), ("pts_ms", "long"), ("x", "double"), ("y", "double"))], *flags)


def read_operator_clicks(spark: SparkSession, path: str) -> DataFrame:
    """parse_clicks() of whole files, with the file they come from."""
    return parse_clicks(spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")))


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """Clicks (pts_ms, kind, x, y); SourceError if one has no whole pts_ms, or there is none."""
    rows = spark.read.option("multiLine", True).schema("pts_ms string, kind string, x double, y double").json(path)
    if rows.isEmpty() or not rows.where(F.col("pts_ms").try_cast("long").isNull() | ~F.col("pts_ms").rlike(r"^-?\d+$")).isEmpty():
        raise SourceError("clicks need whole milliseconds")
    return rows.withColumn("pts_ms", F.col("pts_ms").cast("long"))


def read_manifest(spark: SparkSession, path: str, item: str, fields: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(f"{item} array<struct<{fields}>>").json(path).select(F.explode(item).alias("x")).select("x.*")


def split_list_column(df: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    """A column of list literals as prefix_0 ... prefix_<n-1>."""
    x = F.from_json(column, "array<double>")
    return df.select(*[c for c in df.columns if c != column], *[F.get(x, F.lit(k)).alias(f"{prefix}_{k}") for k in range(n)])


def list_package(spark: SparkSession, path: str, token: str = r"(\d{3})") -> DataFrame:
    """(path, ext, clip_index) of all files below a folder; contents are not read, empty files do not show."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.regexp_extract("path", token + r"[^/]*$", 1).try_cast("int").alias("clip_index"))


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(path).na.drop("all")


def write_results(df: DataFrame, path: str, nest: list[str], by: list[str]) -> None:
    """A JSON document for each of `by`, with the other columns named as a nested list."""
    df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*nest))).alias("items")).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)



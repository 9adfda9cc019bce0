"""Views of the given tables as the engine's own: frames, windows, intervals, pools, logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table in one part, and turns, which become many more rows than others: what a task holds does not grow with the table.
PART_ROWS, PART_TURNS = 100_000, 2_500


#: MB of a file that a task reads at once: it holds them all while it deals them to more than some 200 parts.
READ_MB = 24


def small_reads(spark: SparkSession) -> None:
    """Sets the parts in which the session reads files to READ_MB, if they are larger."""
    name = "spark.sql.files.maxPartitionBytes"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > READ_MB << 20:
        spark.conf.set(name, f"{READ_MB}m")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, most: int = PART_ROWS) -> DataFrame:
    """A table by its key in parts of about `most` rows: parts that Spark reads it in, or puts together after a shuffle, go by bytes
    before their rows multiply. The count is read from the footers of the files."""
    small_reads(spark)
    rows = table(spark, sf_dir, name)
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most)), key)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 frames a second; a supplier is a clip (file_index), ten clips are a recording."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = dealt(spark, sf_dir, "lineitem", "l_suppkey").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(
        F.col("l_suppkey").alias("file_index"),
        (F.col("l_suppkey") % 10).alias("recording_id"),
        "idx",
        (F.col("idx") * 1000.0 / 30).alias("timestamp"),
        F.least(F.lit(1.0), F.col("l_discount") * 12).alias("joint_confidence"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 10000).alias("macro_motion_energy"),
        ((F.col("l_quantity") - 25) / 100).alias("gaze_x"),
        ((F.col("l_tax") - 0.04) * 5).alias("gaze_y"),
        (F.col("l_extendedprice") / 50000 - 1).alias("gaze_z"),
        (F.col("l_quantity") / 50).alias("AU12"),
        (F.col("l_discount") * 10).alias("AU6"),
        (F.col("l_tax") * 10).alias("AU4"),
        (F.col("l_quantity") / 60).alias("AU1"),
        F.when(F.col("l_linenumber") != 6, F.col("l_discount") * 4).alias("AU9"),
        (F.col("l_extendedprice") / 80000).alias("AU25"),
        (F.col("l_tax") * 6).alias("AU26"),
        F.when(F.col("l_returnflag") != "N", 1.0).otherwise(0.0).alias("is_audio_active"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax") * 12).alias("face_confidence"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("is_blinking"),
        F.col("l_returnflag").alias("emotion_label"),
    )


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as labelled windows of six subjects: A is positive, R negative, N neutral."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return dealt(spark, sf_dir, "lineitem", "l_suppkey").select(
        (F.col("l_suppkey") % 6).alias("subject"),
        F.col("l_suppkey").alias("clip"),
        (F.row_number().over(order) - 1).cast("long").alias("window_id"),
        F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


CHANNELS = ("quantity", "price", "discount", "tax")


def long_form(windows: DataFrame, ids: list[str], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """A row for each channel. Exploded, rows stay in the part of their clip; unpivot would have Spark deal them again."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in channels])).alias("_c")
    return windows.select(*ids, each).select(*ids, "_c.channel", "_c.value")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation one after another, 50 ms a letter, with pauses of 100, 200, ... ms between them."""
    rows = dealt(spark, sf_dir, "conversations", "conv_id", PART_TURNS).withColumn("len", F.coalesce(F.length("text"), F.lit(0)) * 50)
    order = W.partitionBy("conv_id").orderBy("turn")
    past = F.coalesce(F.sum("len").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pauses = F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)) * 100
    rows = rows.select(F.col("conv_id").alias("file_index"), "turn", (past + pauses).alias("start_ms"), F.col("len"), F.col("role").alias("label"))
    return rows.select("file_index", "turn", "start_ms", (F.col("start_ms") + F.col("len")).alias("end_ms"), "label")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).where("turn % 3 = 0")
    return rows.select("file_index", (F.col("start_ms") + 500).alias("start_ms"), (F.col("end_ms") + 500).alias("end_ms"))


def event_ms():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1000


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups open a phase of one to a hundred hours, by the k of their properties; ten user groups."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    rows = rows.select((F.col("user_id") % 10).alias("grp"), "event_id", event_ms().cast("double").alias("start_ms"), k.alias("k"))
    return rows.select("grp", "event_id", "start_ms", (F.col("start_ms") + (F.coalesce("k", F.lit(0)) + 1) * 3600000.0).alias("end_ms"), F.concat(F.lit("p"), F.col("event_id") % 7).alias("phase"))


def vad_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech probabilities of 32 ms steps: a user is a file."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    prob = F.get_json_object("props", "$.k").cast("double") / 100
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_index"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.coalesce(prob, F.lit(0.0)).alias("prob"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("kind"), (2000 + (F.col("vec_id") % 7) * 1000).alias("duration_ms"), F.col("embedding").alias("vector")
    )

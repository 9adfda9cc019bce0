"""Audit logs: canonical hashes, chain checks, order, lanes of a timeline."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.prefix import sum_before


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys and no blanks, in ASCII; null for what is not JSON or holds a NaN."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
    except ValueError:
        return None


def bad_ms(text: str | None) -> list[str]:
    """Paths of the keys ending in _ms, at any depth, whose values are not whole numbers; null and booleans are none."""
    out: list[str] = []

    def walk(x, path: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if k.endswith("_ms") and type(v) is not int:
                    out.append(f"{path}{k}")
                walk(v, f"{path}{k}.")
        elif isinstance(x, list):
            for k, v in enumerate(x):
                walk(v, f"{path}{k}.")

    try:
        walk(json.loads(text or "null"), "")
    except ValueError:
        out.append("not JSON")
    return sorted(out)


def with_hashes(log: DataFrame, column: str = "payload") -> DataFrame:
    """log with payload_sha256 recomputed from the canonical form, and the violations of whole milliseconds."""

    def of(texts: pd.Series) -> pd.DataFrame:
        forms = [canonical(t) for t in texts]
        return pd.DataFrame({"sha": [hashlib.sha256(f.encode()).hexdigest() if f is not None else None for f in forms], "bad": [bad_ms(t) for t in texts]})

    x = F.pandas_udf(of, "struct<sha string, bad array<string>>")(column)
    return log.withColumn("_x", x).withColumns({"payload_sha256": F.col("_x.sha"), "bad_ms": F.col("_x.bad")}).drop("_x")


def order_log(orders: DataFrame) -> DataFrame:
    """Orders as the logs of customers: entries hashed by their columns, each naming the entry before; every thousandth wrongly, every
    thousandth not at all."""
    h = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256)
    order = W.partitionBy("log").orderBy("o_orderkey")
    rows = orders.select(F.col("o_custkey").alias("log"), "o_orderkey", h.alias("entry_sha"))
    rows = rows.withColumns({"seq": (F.row_number().over(order) - 1).cast("long"), "_p": F.coalesce(F.lag("entry_sha").over(order), F.lit("genesis"))})
    return rows.select("log", "seq", "entry_sha", F.when(F.col("o_orderkey") % 1000 == 999, "broken").when(F.col("o_orderkey") % 1000 == 500, F.lit(None).cast("string")).otherwise(F.col("_p")).alias("prev_sha"))


def verify_chain(log: DataFrame) -> DataFrame:
    """By log: entries, and the first position whose number or link to the entry before is wrong or missing (null: none).

    An entry without a number comes first and is wrong; its position is that of its place.
    """
    order = W.partitionBy("log").orderBy("seq")
    rows = log.withColumns({"_want": F.coalesce(F.lag("entry_sha").over(order), F.lit("genesis")), "_n": (F.row_number().over(order) - 1).cast("long")})
    bad = ~F.col("prev_sha").eqNullSafe(F.col("_want")) | ~F.col("seq").eqNullSafe(F.col("_n"))
    return rows.groupBy("log").agg(F.count("*").alias("entries"), F.min(F.when(bad, F.coalesce("seq", "_n"))).alias("first_bad"))


def merged_order(events: DataFrame) -> DataFrame:
    """Positions of a log's records by time, kind and payload hash: the order does not depend on who wrote first."""
    order = W.partitionBy("user_id").orderBy("ts", "event_type", F.sha2(F.coalesce("props", F.lit("")), 256), "event_id")
    return events.select("user_id", "event_id", F.row_number().over(order).cast("long").alias("n"))


def unwrap(records: DataFrame, keys: tuple[str, ...] = ("operation", "payload", "worker")) -> DataFrame:
    """records with body: the payload of a worker's wrapper, told by its exact keys, else the record itself."""
    wrapped = F.array_sort(F.json_object_keys("record")) == F.array_sort(F.array(*map(F.lit, keys)))
    return records.withColumn("body", F.when(wrapped, F.get_json_object("record", "$.payload")).otherwise(F.col("record")))


def lanes(turns: DataFrame, regions: DataFrame, durations: DataFrame) -> DataFrame:
    """(lane, file_index, g0, g1, label) on the global clock: files one after another."""
    offsets = sum_before(durations, "file_index", {"off": F.col("duration_ms")}).select("file_index", "off")
    a = turns.select(F.lit("turn").alias("lane"), "file_index", "start_ms", "end_ms", "label")
    b = regions.select(F.lit("overlap").alias("lane"), "file_index", "start_ms", "end_ms", F.lit(None).cast("string").alias("label"))
    rows = a.unionByName(b).join(offsets, "file_index")
    return rows.select("lane", "file_index", (F.col("start_ms") + F.col("off")).alias("g0"), (F.col("end_ms") + F.col("off")).alias("g1"), "label")


def bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.min("g0"), F.lit(0)).alias("g0"), F.coalesce(F.max("g1"), F.lit(1000)).alias("g1"))


def peaks(samples: DataFrame, width: int) -> DataFrame:
    """(file_index, col, peak): greatest amplitude of each stretch of width ms, of full scale 32768."""
    return samples.groupBy("file_index", F.floor(F.col("t_ms") / width).alias("col")).agg((F.max(F.abs("x")) / 32768).alias("peak"))


def reason(tier, target, other, high, margin):
    """A sentence for a block's tier."""
    return (
        F.when(tier == "HIGH", F.format_string("target score %.2f above %.2f", target, high))
        .when((tier == "MEDIUM") & margin, F.format_string("target score %.2f, but the other voice scores %.2f", target, other))
        .when(tier == "SKIPPED", F.lit("too little speech to score"))
        .otherwise(F.format_string("target score %.2f", target))
    )


def recomputed(log: DataFrame, parts: list[str]) -> DataFrame:
    """By log: entries, and the first position whose hash is not that of its own columns (null: none)."""
    want = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256)
    return log.groupBy("log").agg(F.count("*").alias("entries"), F.min(F.when(~F.col("entry_sha").eqNullSafe(want), F.col("seq"))).alias("first_changed"))


def warnings(records: DataFrame, kinds: list[str]) -> DataFrame:
    """By log and kind of warning: how many records, and when the first and last were. records: (log, kind, ts)."""
    rows = records.where(F.col("kind").isin(kinds))
    return rows.groupBy("log", "kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

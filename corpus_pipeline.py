"""From documents to packed training sequences: what each stage keeps is written and read again by the next.

Every stage takes an empty table and gives one. Repeated rows are documents of their own until near-duplicates are folded, and
a null doc_id is kept like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brolga.llm.common import materialize, small_batches, table
from brolga.llm.decontaminate import decontaminate
from brolga.llm.language import fit, held_out, predict
from brolga.llm.packing import pack
from brolga.llm.recompress import dedup_substrings
from brolga.llm.simhash import near_duplicates


def _wrapped(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, text, _doc): whatever other columns they have, an operator's own cannot clash with them."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"))


def _unwrapped(found: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of documents again, some of them changed."""
    kept = {"text": F.col("text")} | changed
    return found.select(*[kept.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a missing label becomes the predicted one.

    Those go that the calibrated models reject: null texts, texts without a letter, and texts far from any language learned.
    """
    model = fit(docs.where(~held_out()))
    found = predict(_wrapped(docs), model).where("not rejected")
    return _unwrapped(found, docs.columns, lang=F.coalesce(F.col("_doc.lang"), F.col("lang_pred")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least doc_id (null last), of repeated rows one.

    Null and blank texts have no shingles and are near-duplicates of one another. Which of equal rows stays is told by the
    least of their row numbers, so that however many there are, only numbers meet.
    """
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")
    stay = found.groupBy("component").agg(first).select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"))
    rows = _wrapped(docs).withColumns({"_text_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    once = rows.groupBy("_text_hash", "doc_id").agg(F.min("_row").alias("_row"))
    kept = once.join(stay, (once["_text_hash"] == stay["_hash"]) & once["doc_id"].eqNullSafe(stay["_id"])).select("_row")
    return _unwrapped(rows.join(kept, "_row", "left_semi"), docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand elsewhere too; untouched texts stay as they are.

    Every place of such a passage loses it. A document of nothing else stays with an empty text, so that no row is lost
    here; null texts stay null.
    """
    found, gone = dedup_substrings(_wrapped(docs)), F.col("n_removed") > 0
    changed = {"text": F.when(gone, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(gone, length).otherwise(F.col("_doc.n_chars"))
    return _unwrapped(found, docs.columns, **changed)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window; null and empty texts have none, so they stay."""
    found = decontaminate(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return _unwrapped(found.where(F.size("hit_words") == 0), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of the documents in sequences of up to 2048: one row for each piece. Null and empty texts are their end alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("substrings", substrings),
    ("benchmark", benchmark),
    ("packing", packing),
]
#: No stage but the benchmark's and the substrings' can be said in SQL; the tests hold all of them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

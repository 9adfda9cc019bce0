"""Text quality by the votes of nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brolga.llm.common import materialize, release, small_batches, table, worker_cache
from brolga.llm.flat import flat, fold_table, words_of

#: Different labelled texts that become neighbours: at most so many, taken in the order of their hash.
ROWS = 6000
#: Terms are hashed: words into the first WORDS buckets, forms of words into the rest.
WORDS, TERMS = 2048, 4096
DIMENSIONS = 64
NEIGHBOURS = 16
#: Similarities are raised to this power before they weigh a vote.
SHARP = 8.0
THRESHOLD = 0.7
#: Documents whose cosines with all neighbours are worked out together, and bytes of text that are cut into terms together.
BLOCK, TOGETHER = 256, 1 << 22

_FOLD = fold_table([*range(33)])
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:33] = 32
#: Forms: capitals, other letters (with all beyond ASCII) and digits each as one sign, however many; other signs as they are.
_FORM = _KEEP.copy()
_FORM[65:91], _FORM[97:123], _FORM[128:], _FORM[48:58] = 65, 97, 97, 48


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) in the order of texts and terms.

    Terms are words between blanks in lower case, their forms (runs of capitals, letters, digits and of any other sign
    as one sign each), and forms of a word that is the one before it again.
    """
    data, bounds = flat(texts)
    words, text = words_of(_FOLD[data], bounds)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    hashed = np.fromiter((zlib.crc32(w) % WORDS for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[code]
    sign = _FORM[data]
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[bounds[(bounds > 0) & (bounds < len(data))]] = True
    kept = np.r_[0, np.cumsum(keep)][bounds]
    forms, _ = words_of(sign[keep], kept)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
    coded = forms.dictionary_encode()
    form = coded.indices.to_numpy()
    rest = TERMS - WORDS
    plain = np.fromiter((WORDS + zlib.crc32(w) % rest for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[form]
    repeated = np.fromiter((WORDS + zlib.crc32(b"again " + w) % rest for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[form]
    key, n = np.unique(np.r_[text * TERMS + hashed, text * TERMS + np.where(again, repeated, plain)], return_counts=True)
    return key // TERMS, key % TERMS, n


def _weighted(text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """A row for each text: log counts times idf, the part of words and that of forms each of length 1."""
    out = np.zeros((texts, TERMS), np.float32)
    out[text, term] = (1 + np.log(n)) * idf[term]
    for part in (out[:, :WORDS], out[:, WORDS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Votes:
    """idf of terms, axes of the latent space, the labelled vectors in it (of length 1), their labels and the mean label."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """For each text the mean label of its nearest neighbours, weighted by similarity; the mean of all for one without words."""
        text, term, n = terms_of(texts)
        out = np.full(len(texts), self.prior)
        edge = np.searchsorted(text, np.arange(0, len(texts) + BLOCK, BLOCK))
        for b in range(len(edge) - 1):
            at = slice(edge[b], edge[b + 1])
            size = min(BLOCK, len(texts) - b * BLOCK)
            own = _unit(_weighted(text[at] - b * BLOCK, term[at], n[at], self.idf, size) @ self.axes)
            # to nine digits, ties by the place of the neighbour: a text has one score, whatever it is multiplied together with
            cosine = np.rint(own @ self.vectors.T * 1e9).astype(np.int64)
            k = min(NEIGHBOURS, cosine.shape[1])
            order = np.arange(cosine.shape[1]) - cosine * cosine.shape[1]
            near = np.sort(np.argpartition(order, k - 1, axis=1)[:, :k], 1) if k else np.zeros((size, 0), int)
            weight = (np.maximum(np.take_along_axis(cosine, near, 1), 0) / 1e9) ** SHARP
            total = weight.sum(1)
            some = (total > 0) & (np.bincount(text[at] - b * BLOCK, minlength=size) > 0)
            out[b * BLOCK : b * BLOCK + size][some] = ((weight * self.labels[near]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, term, n = terms_of(batch.column("text"))
        edge = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (term.astype(np.int16), n.astype(np.int32))]
        yield pa.record_batch([batch.column("h"), batch.column("label"), *lists], names=["h", "label", "terms", "counts"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(h, label, text): up to `rows` different labelled texts with each of their labels, as a written table.

    Labels meet ids and hashes only. Texts are told apart by their hash and taken by the order of another hash of it, so
    that a text with a third of all rows counts once; texts are read again for the chosen hashes alone.
    """
    told = labels.where("label is not null").select("doc_id", F.col("label").cast("int")).distinct()
    ids = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")).distinct()
    chosen = ids.join(told, "doc_id").select("h", "label").distinct().orderBy(F.xxhash64("h", F.lit("draw")), "h", "label").limit(rows)
    chosen = materialize(chosen)
    texts = docs.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen.select("h").distinct()), "h").groupBy("h").agg(F.min("text").alias("text"))
    return materialize(chosen.join(texts, "h"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, dimensions: int = DIMENSIONS) -> Votes:
    """The labelled vectors for docs (doc_id, text) with labels (doc_id, label of 0 or 1).

    Only rows of docs that have a label teach; a doc_id with both labels counts for both, null labels, texts and ids teach
    nothing, and equal texts count once for each label. `rows` bounds what is sampled, comes to the driver (terms and
    counts, at most TERMS for each text) and is broadcast. The axes are the leading right singular vectors of the sampled
    texts' weighted terms, by subspace iteration.
    """
    small_batches(docs.sparkSession)
    taken = sample(docs, labels, rows).mapInArrow(_rows, "h long, label int, terms array<short>, counts array<int>").toPandas()
    taken = taken.sort_values(["h", "label"], ignore_index=True)
    if not len(taken):
        return Votes(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    sizes = taken.terms.map(len).to_numpy()
    text, term, n = np.repeat(np.arange(len(taken)), sizes), np.concatenate(taken.terms).astype(np.int64), np.concatenate(taken.counts)
    idf = np.log((1 + len(taken)) / (1 + np.bincount(term, minlength=TERMS))) + 1
    matrix = _weighted(text, term, n, idf, len(taken))
    dimensions = min(dimensions, *matrix.shape)
    basis = np.random.default_rng(0).standard_normal((TERMS, min(dimensions + 16, *matrix.shape)), np.float32)
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    axes = (basis @ turn.T[:, :dimensions]).astype(np.float64)
    labelled = taken.label.to_numpy(np.float64)
    return Votes(idf, axes, _unit(matrix @ axes), labelled, float(labelled.mean()))


def _score(sent: Broadcast):
    def score(texts: pd.Series) -> pd.Series:
        worker_cache("quality")
        texts = pa.array(texts, pa.large_string())
        total = np.cumsum(np.diff(flat(texts)[1]))
        cut = np.unique(np.r_[0, np.flatnonzero(np.diff(total // TOGETHER)) + 1, len(texts)])
        out = [sent.value.scores(texts.slice(a, b - a)) for a, b in zip(cut[:-1], cut[1:])]
        release()
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.pandas_udf(score, "double")


def judge(docs: DataFrame, votes: Votes, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, the neighbours' share of label 1) and predicted (1 from threshold on) added.

    Columns of these names are replaced; others pass through. Only the whole text is looked at. Null, empty and blank texts
    have no words and get the mean label of the sample (0.5 if nothing is labelled). Rows stay as they are. Each task compares
    its documents, a block at a time, with every labelled vector.
    """
    docs = docs.drop("score", "predicted")
    docs = docs.withColumn("score", _score(docs.sparkSession.sparkContext.broadcast(votes))("text"))
    return docs.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from `labels.quality` of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    votes = fit(docs.where(~held_out()), labels)
    return judge(docs, votes).select("doc_id", held_out().alias("held_out"), "score", "predicted")

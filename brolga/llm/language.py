"""Language ID by interpolated Kneser-Ney models of characters, kept in sorted arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.llm.common import materialize, release, small_batches, table, worker_cache

ORDER = 4
#: Labelled rows of a language that the models are fitted on (about; all, if there are fewer), and their letters at most, but
#: for the first text. Every tenth different text calibrates.
ROWS, LETTERS = 4000, 40_000_000
#: How far beyond the usual a text may lie before it is rejected: this times the 0.999 quantile of the calibration rows, at least LEAST.
SLACK, LEAST = 1.5, 6.0
#: Letters from which on more evidence does not make the score surer.
EVIDENCE = 50
UNKNOWN = "und"
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHARS = 1 << 18


def _power(n: int) -> np.uint64:
    """What the n-th letter from the end is multiplied by."""
    return np.uint64(pow(int(_MIX), n, 1 << 64))


def _letter_table() -> np.ndarray:
    kept = worker_cache("language")
    if not kept:
        points = np.arange(0x110000, dtype=np.uint32)
        points[[not chr(i).isalpha() for i in range(0x110000)]] = _SPACE
        kept["letters"] = points
    return kept["letters"]


def letters(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of lower-case letters, each behind order-1 spaces and with one at its end, and their bounds.

    What lies between letters becomes one space.
    """
    pad = " " * (order - 1)
    raw = [np.frombuffer((pad + (t or "").lower() + " ").encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    chars = _letter_table()[np.concatenate(raw)] if raw else np.zeros(0, np.uint32)
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != _SPACE) | (chars[:-1] != _SPACE)
    start = np.cumsum(sizes) - sizes
    for k in range(order - 1):
        keep[start + k] = True
    return chars[keep], np.r_[0, np.cumsum(keep)[start + sizes - 1]] if raw else np.zeros(1, np.int64)


def hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to order the hash of the n letters that end at a position (wrong for the first n-1 positions)."""
    c = chars.astype(np.uint64) + np.uint64(1)
    out = [c * _MIX]
    for n in range(1, order):
        before = np.zeros_like(c)
        before[n:] = c[: len(c) - n]
        out.append(out[-1] + before * _power(n + 1))
    return out


@dataclass
class Models:
    """Models of all languages: for each order sorted hashes of grams and of contexts, with a column for each language.

    share is the discounted part of a gram in its context, left the weight that a context leaves to the next shorter one.
    """

    languages: list[str]
    order: int
    floor: float = 1.0
    grams: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    #: For each language the mean cross-entropy, its variance and what one letter adds to it, and the bound in deviations.
    usual: list[tuple[float, float, float, float]] = field(default_factory=list)

    def log2(self, gram: list[np.ndarray]) -> np.ndarray:
        """log2 probability of the last letter of grams (hashes by order) after the letters before it, by language."""

        def rows(table: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
            at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
            out = np.full((len(wanted), len(self.languages)), other)
            if len(table):
                hit = table[at] == wanted
                out[hit] = values[at[hit]]
            return out

        p = np.full((len(gram[0]), len(self.languages)), self.floor)
        for n in range(self.order):
            context = gram[n] - gram[0] if n else np.zeros_like(gram[0])
            p = rows(self.grams[n], self.share[n], gram[n], 0.0) + rows(self.contexts[n], self.left[n], context, 1.0) * p
        return np.log2(p)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a letter by text and language, and the letters (and spaces) that were predicted."""
        chars, bounds = letters(texts, self.order)
        gram = hashes(chars, self.order)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        told = np.arange(len(chars)) - bounds[:-1][text] >= self.order - 1
        place, text = np.flatnonzero(told), text[told]
        code, _ = pd.factorize(gram[-1][place])
        first = np.empty(code.max() + 1 if len(code) else 0, np.int64)
        first[code[::-1]] = place[::-1]
        bits = -self.log2([g[first] for g in gram])
        n = np.bincount(text, minlength=len(texts))
        total = [np.bincount(text, bits[code, k], len(texts)) for k in range(len(self.languages))]
        return np.stack(total, 1) / np.maximum(n, 1)[:, None], n


def _learn(counts: pd.DataFrame, order: int) -> Models:
    """counts: lang, n and the letters c1..c<order> of each gram of the longest order. Lower orders count distinct predecessors."""
    model = Models(sorted(counts.lang.unique()), order)
    where = {x: k for k, x in enumerate(model.languages)}
    cols = [f"c{k + 1}" for k in range(order)]
    model.floor = 1.0 / (counts[cols[-1]].nunique() + 1)
    now = counts.assign(lang=counts.lang.map(where))
    for n in range(order, 0, -1):
        own = cols[order - n :]
        if n < order:
            now = now.groupby(["lang", *own], sort=False).size().reset_index(name="n")
        gram = np.zeros(len(now), np.uint64)
        for k, c in enumerate(reversed(own)):
            gram = gram + (now[c].to_numpy(np.uint64) + np.uint64(1)) * _power(k + 1)
        context = gram - (now[own[-1]].to_numpy(np.uint64) + np.uint64(1)) * _MIX
        f = pd.DataFrame({"lang": now.lang, "g": gram, "h": context, "n": now.n.astype(float)})
        once = f.n.eq(1).groupby(f.lang).sum().reindex(range(len(where)), fill_value=0)
        twice = f.n.eq(2).groupby(f.lang).sum().reindex(range(len(where)), fill_value=0)
        d = ((once + 1) / (once + 1 + 2 * (twice + 1))).clip(0.1, 0.95)
        f["d"] = f.lang.map(d)
        by = f.groupby(["lang", "h"], sort=False)
        total = by.n.transform("sum")

        def matrix(keys: pd.Series, langs: pd.Series, values: pd.Series, other: float) -> tuple[np.ndarray, np.ndarray]:
            table, at = np.unique(keys.to_numpy(), return_inverse=True)
            out = np.full((len(table), len(where)), other)
            out[at, langs.to_numpy()] = values.to_numpy()
            return table, out

        for into, values, made in (
            (model.grams, model.share, matrix(f.g, f.lang, (f.n - f.d).clip(lower=0) / total, 0.0)),
            (model.contexts, model.left, matrix(f.h, f.lang, f.d.clip(upper=1) * by.n.transform("size") / total, 1.0)),
        ):
            into.insert(0, made[0])
            values.insert(0, made[1])
    return model


def _count(order: int):
    names = [f"c{k + 1}" for k in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                times, at = part.times.to_numpy(np.int64), 0
                for texts in _blocks(part.text):
                    weight, at = times[at : at + len(texts)], at + len(texts)
                    chars, bounds = letters(texts, order)
                    gram = hashes(chars, order)[-1]
                    inside = np.arange(len(chars)) - np.repeat(bounds[:-1], np.diff(bounds)) >= order - 1
                    place = np.flatnonzero(inside)
                    _, first, code = np.unique(gram[place], return_index=True, return_inverse=True)
                    n = np.bincount(code, np.repeat(weight, np.diff(bounds))[place]).astype(np.int64)
                    last = place[first]
                    cols = [chars[last - order + 1 + k].astype(np.int32) for k in range(order)]
                    yield pa.record_batch([pa.array([lang] * len(n)), *map(pa.array, cols), pa.array(n)], names=["lang", *names, "n"])

    return run, names


def _blocks(texts) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= _CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def fit(labelled: DataFrame, order: int = ORDER, rows: int = ROWS, most: int = LETTERS) -> Models:
    """Models from labelled (text, lang); rows with a null in either teach nothing.

    About `rows` rows of each language are taken, copies of one text by their share like any others: a text with n of a
    language's N rows is taken with weight n * rows / N, rounded up or down by its hash, and is one row with that weight. So no
    copies are ever gathered; columns but text and lang are not looked at. Every language keeps its heaviest text at
    least, never more than twice `rows` different ones, and no more than `most` letters (but always one text). That
    bounds the work and what comes to the driver and is broadcast. Grams are counted in Spark. The tenth, twentieth and so
    on of the texts taken calibrate: the usual cross-entropy of each language, its spread by length, and how far off a text
    may be; so every language is learned, from one row too. A language with under 20 such texts takes those of all, and
    nothing is rejected if these are under 20. Labels are taken to be few. An empty table gives a model without languages.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    kinds = materialize(known.groupBy("lang", "h").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("letters")))
    sizes = {r.lang: r.n for r in kinds.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return Models([], order)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))])
    chance = F.pmod(F.xxhash64("h", "lang", F.lit("draw")), F.lit(1 << 20)) / (1 << 20)
    kinds = kinds.withColumn("due", F.col("n") * share[F.col("lang")] + chance)
    heaviest = kinds.groupBy("lang").agg(F.max_by("h", F.struct("due", "h")).alias("_h"))
    drawn = kinds.join(F.broadcast(heaviest), "lang").where((F.col("due") >= 1) | (F.col("h") == F.col("_h"))).drop("_h")
    order_of = W.partitionBy("lang").orderBy(F.desc(F.col("due") >= 1), F.xxhash64("h", F.lit("order")), "h")
    drawn = drawn.withColumns({"nth": F.row_number().over(order_of), "sum": F.sum("letters").over(order_of.rowsBetween(W.unboundedPreceding, W.currentRow))})
    drawn = drawn.where((F.col("nth") == 1) | ((F.col("nth") <= 2 * rows) & (F.col("sum") <= most)))
    drawn = drawn.select("lang", "h", "nth", F.greatest(F.lit(1), F.floor("due")).cast("long").alias("times"))
    taken = materialize(known.join(F.broadcast(materialize(drawn)), ["lang", "h"]).groupBy("lang", "h", "nth", "times").agg(F.min("text").alias("text")).drop("h"))
    held = F.col("nth") % 10 == 0
    run, names = _count(order)
    grams = taken.where(~held).select("text", "lang", "times").mapInArrow(run, "lang string, " + ", ".join(f"{c} int" for c in names) + ", n long")
    model = _learn(grams.groupBy("lang", *names).agg(F.sum("n").alias("n")).toPandas(), order)
    sent = spark.sparkContext.broadcast(model)
    found = taken.where(held).select("lang", _predict(sent)("text").alias("x")).select("lang", "x.bits", "x.n").where("n > 1").toPandas()
    for lang in model.languages:
        own = found[found.lang == lang]
        own = own if len(own) >= 20 else found
        if len(own) < 20:
            model.usual.append((0.0, 1.0, 0.0, np.inf))
            continue
        mean, inverse = float(own.bits.median()), 1 / own.n
        off = (own.bits - mean) ** 2
        slope = max(0.0, float(np.polyfit(inverse, off, 1)[0])) if inverse.nunique() > 1 else 0.0
        base = max(float((off - slope * inverse).mean()), 1e-4)
        z = (own.bits - mean) / np.sqrt(base + slope * inverse)
        model.usual.append((mean, base, slope, max(LEAST, SLACK * float(z.quantile(0.999)))))
    sent.unpersist()
    return model


def _predict(sent: Broadcast):
    def predict(texts: pd.Series) -> pd.DataFrame:
        model, out = sent.value, []
        for block in _blocks(texts):
            h, n = model.entropies(block)
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            weight = np.exp2(-(h - low[:, None]) * np.minimum(n, EVIDENCE)[:, None])
            off = np.zeros(len(h), bool)
            if model.usual:
                mean, base, slope, bound = np.array(model.usual)[best].T
                off = low > mean + bound * np.sqrt(base + slope / np.maximum(n, 1))
            names = np.array(model.languages, object)[best]
            out.append(pd.DataFrame({"lang": names, "score": 1 / weight.sum(1), "bits": low, "n": n, "rejected": off}))
        release()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang": [], "score": [], "bits": [], "n": [], "rejected": []})

    return F.pandas_udf(predict, "struct<lang string, score double, bits double, n long, rejected boolean>")


def predict(docs: DataFrame, model: Models, text: Column | str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy (bits a letter) and rejected added (columns of these names go).

    The language is the one of least cross-entropy over the whole text, divided by its length (a tie: the first by name).
    A text that is null or has no letter is UNKNOWN with score 0, without cross-entropy, and rejected; so is every text
    if nothing was learned. Else a text is rejected if its cross-entropy lies beyond the calibrated bound of its language.
    Nothing but the text is looked at; rows stay as they are, repeated ones and null ids included.
    """
    names = ("lang_pred", "score", "cross_entropy", "rejected")
    docs = docs.drop(*names, "_said")
    text = F.col(text) if isinstance(text, str) else text
    if not model.languages:
        empty = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)}
        return docs.withColumns(empty)
    said = _predict(docs.sparkSession.sparkContext.broadcast(model))(text)
    some = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    x = F.col("_said")
    return docs.withColumn("_said", said).withColumns(
        {
            "lang_pred": F.when(some, x.lang).otherwise(UNKNOWN),
            "score": F.when(some, x.score).otherwise(0.0),
            "cross_entropy": F.when(some, x.bits),
            "rejected": ~some | x.rejected,
        }
    ).drop("_said")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; with cross_entropy and rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")

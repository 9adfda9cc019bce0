"""SimHash near-duplicates: Golay decoding of fingerprint segments gives the keys under which close fingerprints meet."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brolga.llm.common import components, materialize, table, worker_cache

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: First bit and length of the three segments; each is one word of the [23,12] Golay code, the last one filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints under one key that one task compares at a time.
BLOCK = 4096
#: One fingerprint of so many shows how many rows a key has; only how they are dealt out depends on it.
SHARE = 16
#: Fingerprints whose keys one task makes, about a hundred for each.
FINGERPRINTS = 1 << 18
_GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over all word shingles; 0 without a word. A bit is set if it is set in over half the shingle hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip((ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _remainder(word: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        word = word ^ np.where(word >> bit & 1, np.int32(_GENERATOR << (bit - 11)), np.int32(0))
    return word


class Golay:
    """The perfect [23,12] code: any word lies within 3 bits of exactly one codeword, whose top 12 bits are its index."""

    def __init__(self):
        patterns = [sum(1 << b for b in bits) for k in range(6) for bits in combinations(range(23), k)]
        errors = np.array(patterns, np.int32)
        weight, syndrome = np.bitwise_count(errors).astype(np.int32), _remainder(errors)
        order = np.lexsort((weight, syndrome))
        #: Error patterns of up to 5 bits by syndrome, lightest first: from a word they lead to the codewords near it.
        self.errors, self.weight = errors[order], weight[order]
        self.start = np.searchsorted(syndrome[order], np.arange(2049))
        #: Syndromes of the parts of a word: the code is linear, so they add up.
        self.low, self.high = _remainder(np.arange(1 << 12, dtype=np.int32)), _remainder(np.arange(1 << 11, dtype=np.int32) << 12)

    def near(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of word, index of codeword, bits beyond 3) of each codeword within 5 bits of a word, the nearest one first."""
        s = self.low[word & 0xFFF] ^ self.high[word >> 12]
        count = self.start[s + 1] - self.start[s]
        row = np.repeat(np.arange(len(word)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.start[s][row]
        return row, (word[row] ^ self.errors[at]) >> 11, np.maximum(self.weight[at] - 3, 0)


def _bits(segment: int, parts: int = 1, part: int = 0) -> int:
    """Mask of one of the equal parts of a segment."""
    at, n = SEGMENTS[segment]
    first, end = n * part // parts, n * (part + 1) // parts
    return (1 << at + end) - (1 << at + first)


def _kinds() -> list[tuple[int, int, int]]:
    """(segment, most, mask): two fingerprints in up to 4 different bits have, for one kind at least, up to `most` of them in
    that segment, which is decoded, and none under the mask, whose bits are in the key as they are.

    If a segment has no wrong bit, another has up to 2, or has 3 or 4 and leaves the last one up to 1. If each has one, two
    have just one, so a half of either is right, and the third has up to 2, so a third part of it is right.
    """
    kinds = [(1, 2, _bits(0)), (2, 1, _bits(0)), (0, 2, _bits(1)), (2, 1, _bits(1)), (0, 2, _bits(2)), (1, 1, _bits(2))]
    for decoded, one, two in ((0, 1, 2), (1, 2, 0), (0, 2, 1)):
        kinds += [(decoded, 1, _bits(one, 2, i) | _bits(two, 3, j)) for i in range(2) for j in range(3)]
    return kinds


KINDS = _kinds()


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) of the keys of fingerprints: two that differ in up to 4 bits share a key that is own to one of them.

    A key is a kind, the bits under its mask and a codeword for its segment. Own to a fingerprint is the codeword nearest
    to it. If the segment has e wrong bits, the codeword nearest to one side is within 3 + e bits of the other, so every
    fingerprint takes as further keys the codewords up to `most` bits beyond 3; only those greater than its own one are
    needed, as the other side has the rest. Codeword and kind stand in the key where the segment's bits were.
    """
    kept = worker_cache("simhash")
    if not kept:
        kept["code"] = Golay()
    near = []
    for at, n in SEGMENTS:
        row, code, over = kept["code"].near(((fingerprints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32))
        own = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        need = own | (code > code[own][row])
        near.append([(row[fit], code[fit].astype(np.uint64), own[fit]) for fit in (need & (over <= most) for most in range(3))])
    rows, found, owned = [], [], []
    for k, (segment, most, mask) in enumerate(KINDS):
        row, code, own = near[segment][most]
        at = SEGMENTS[segment][0]
        rows.append(row)
        found.append(((fingerprints & np.uint64(mask))[row] | code << np.uint64(at) | np.uint64(k << at + 12)).view(np.int64))
        owned.append(own)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(owned)


def forest(f: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between fingerprints that differ in up to `most` bits, enough of them to connect all that are connected."""
    edges = []
    while len(f):
        reached, f = [f[0]], f[1:]
        while reached and len(f):
            x = reached.pop()
            near = np.bitwise_count(f ^ x) <= most
            if near.any():
                to = f[near]
                edges.append((np.full(len(to), x), to))
                reached.extend(to)
                f = f[~near]
    return edges


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(f), 2048):
            part = f[at : at + 2048]
            row, key, own = keys(part)
            yield pa.record_batch({"key": key, "own": own, "fp": part[row].view(np.int64)})


def _compare(batches: Iterator[pa.RecordBatch], most: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Edges within runs of rows of one (key, i, j), which come sorted."""
    rest: list[np.ndarray] = [np.zeros((0,), np.int64)] * 5

    def edges(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        run = np.flatnonzero(np.r_[True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0), True]) if len(cols[0]) else np.zeros(1, int)
        f, own, size = cols[3].view(np.uint64), cols[4], np.diff(run)
        a, b = [], []
        for n in range(2, 17):
            at = run[:-1][size == n]
            if not len(at):
                continue
            for i, j in combinations(range(n), 2):
                x, y = f[at + i], f[at + j]
                near = (np.bitwise_count(x ^ y) <= most) & (x != y)
                a.append(x[near])
                b.append(y[near])
        for k in np.flatnonzero(size > 16):
            s = slice(run[k], run[k + 1])
            if own[s].any():
                for x, y in forest(np.unique(f[s]), most):
                    a.append(x)
                    b.append(y)
        if sum(map(len, a)):
            pair = np.unique(np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)]), axis=1)
            yield pa.record_batch({"a": pair[0], "b": pair[1]})

    for batch in batches:
        cols = [np.concatenate([r, batch[n].to_numpy(zero_copy_only=False)]) for r, n in zip(rest, ("key", "i", "j", "fp", "own"), strict=True)]
        last = 0
        if len(cols[0]):
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [c[last:] for c in cols]
        yield from edges([c[:last] for c in cols])
    yield from edges(rest)


def links(fingerprints: DataFrame, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (column fp) at up to 4 differing bits that connect all that are connected.

    Under a key, fingerprints at home there are compared with each other and with its guests. Both are dealt to blocks of
    about `block` if there are more, by what one fingerprint of `share` shows, and each pair of blocks, two at home or one
    at home and one of guests, is compared by itself; so a task holds about two blocks at once, whoever a key is full of.
    """
    rows = fingerprints.mapInArrow(_emit, "key long, own boolean, fp long")
    some = fingerprints.where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(share)) == 0).mapInArrow(_emit, "key long, own boolean, fp long")
    seen = some.groupBy("key").agg((F.sum(F.col("own").cast("int")) * share).alias("home"), (F.count("*") * share).alias("all"))
    hot = materialize(
        seen.where(F.col("all") > block).select(
            "key",
            F.greatest(F.lit(1), F.ceil(F.col("home") / block)).cast("int").alias("n"),
            F.ceil((F.col("all") - F.col("home")) / block).cast("int").alias("m"),
        )
    )
    if hot.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        rows = rows.join(hot, "key", "left").withColumns({"n": F.coalesce("n", F.lit(1)), "m": F.coalesce("m", F.lit(0))})
        x, y = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"), F.pmod(F.xxhash64("fp"), F.greatest("m", F.lit(1))).cast("int")
        homes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, x).alias("i"), F.greatest(k, x).alias("j")))
        beside = F.transform(F.sequence(F.lit(0), F.greatest("m", F.lit(1)) - 1), lambda k: F.struct(x.alias("i"), (F.col("n") + k).alias("j")))
        guests = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(k.alias("i"), (F.col("n") + y).alias("j")))
        cells = F.when(F.col("m") == 0, homes).when(F.col("own"), F.concat(homes, beside)).otherwise(guests)
        rows = rows.select("key", "own", "fp", F.explode(cells).alias("c")).select("key", "own", "fp", "c.i", "c.j")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "a long, b long")


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, text_hash, fp, component, component_id) for each row of docs.

    fp is the fingerprint as a signed long, component a number of the rows linked over steps of at most 4 bits (a
    fingerprint among them), component_id their least doc_id, text_hash xxhash64(text). Null, empty and blank texts have
    fingerprint 0 and are linked like any other. Repeated rows stay; rows with a null doc_id keep it and take the
    component_id of their component (null if no row of it has an id).
    Copies are folded to one fingerprint before any comparison, and only fingerprints travel.
    """
    told = F.pandas_udf(_fingerprints, "long")("text")
    prints = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), told.alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // FINGERPRINTS))
    linked = components(links(distinct.select("fp").repartition(tasks, "fp")))
    of = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    of = of.select("fp", "first", F.coalesce("root", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(least, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""LM scoring from a log-frequency Bloom filter: quantised n-gram counts are read back by repeated membership probes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brolga.llm.common import materialize, table

#: A count c >= least is kept as level 1 + floor(log(c / least) / log(BASE)), one more for pairs, whose first level is a count of 1.
BASE = 1.25
LEAST = {1: 1, 2: 2}
#: Bits and hash functions for each n-gram and level; filters of more than MOST_BYTES are not broadcast, but asked by shuffle.
BITS, HASHES, MOST_BYTES = 12, 3, 256 << 20
#: Levels of a word told apart in how far what follows it is trusted, and cells of log2 ratios that are counted for that.
LEVELS, CELLS = 96, 128
#: Frequent words whose exact counts are broadcast for the base score; the others are joined.
HEAD = 1 << 18
BLOCK, BUCKET = 3 << 17, 1 << 19
#: High levels that a worker remembers.
KNOWN = 1 << 19
#: Letters whose words are named together.
LETTERS = 1 << 19
#: Letters of the texts that share the answers of filters asked by shuffle.
SHARE = 1 << 22
#: What stands for the end of a text, and before its first word.
END = 0x0E4D
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ID = np.uint64(16)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64)]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the words of texts, A-Z in lower case, with END after each text's last; and each text's first token.

    A name is a hash of all bytes of its word, worked out for all words together.
    """
    data = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = _WORD[raw]
    first = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    size = np.flatnonzero(~inside & np.r_[False, inside[:-1]]) - first
    if len(size) and size.max() > len(_powers[0]):
        power = np.full(2 * int(size.max()), _A)
        power[0] = 1
        _powers[0] = np.cumprod(power, dtype=np.uint64)
    start = np.cumsum(size) - size
    letters = raw[inside].astype(np.uint64) + np.uint64(1)
    letters *= _powers[0][np.arange(len(letters)) - np.repeat(start, size)]
    names = mix(np.add.reduceat(letters, start)) if len(start) else np.zeros(0, np.uint64)
    ends = np.searchsorted(first, np.cumsum([len(d) + 1 for d in data]))
    names = np.insert(names, ends, np.uint64(END))
    return names, np.r_[0, ends[:-1]] + np.arange(len(texts))


def pairs(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """48-bit names of each token with the one before it; `first` are the places where a text starts."""
    before = np.r_[np.uint64(END), names[:-1]]
    before[first] = END
    return mix(before * _A + names) >> _ID


def single(names: np.ndarray) -> np.ndarray:
    """48-bit names of tokens for the filter."""
    return mix(names ^ _C) >> _ID


def level(count: np.ndarray, least: int) -> np.ndarray:
    """The level of a count: 0 for none; where counts begin at 2, a count of 1 has the first level to itself."""
    above = 1 + np.floor(np.log(np.maximum(count, least) / least) / np.log(BASE) + 1e-9)
    return np.where(count < 1, 0, np.where(count < least, 1, above + least - 1)).astype(np.int64)


def _bounds(least: int) -> tuple[np.ndarray, np.ndarray]:
    levels = np.arange(1, 400.0)
    low = np.ceil(least * BASE ** (levels - 1) - 1e-9)
    high = np.maximum(np.ceil(least * BASE**levels - 1e-9) - 1, low)
    below = np.arange(1.0, least)
    return np.r_[0.0, below, low], np.r_[0.0, below, high]


_BOUNDS = {least: _bounds(least) for least in set(LEAST.values())}


def least_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The smallest count that a level stands for; 0 for level 0."""
    return _BOUNDS[least][0][levels]


def most_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The largest count that a level stands for; 0 for level 0."""
    return _BOUNDS[least][1][levels]


def _bit(hashed: np.ndarray, j: int, size: np.ndarray) -> np.ndarray:
    """The j-th place, below size, of what was hashed once: half of the hash as start, half as step."""
    low = np.uint64(0xFFFFFFFF)
    return (((hashed >> np.uint64(32)) + np.uint64(j) * (hashed & low | np.uint64(1)) & low) * size) >> np.uint64(32)


@dataclass
class Filter:
    """Bloom filters of one order, one for each range of names; levels[x] of a name is how often it says yes in a row."""

    least: int
    shift: int
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray
    #: Names at high levels, which take most probes, in order, and their levels: what a worker has found so far.
    known: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def levels(self, ids: np.ndarray) -> np.ndarray:
        out, live, lev = np.zeros(len(ids), np.int64), np.argsort(ids), 1  # in order, so that probes stay in one part at a time
        bucket = (ids[live] >> np.uint64(self.shift)).astype(np.int64)
        some = self.size[bucket] > 0
        live, bucket = live[some], bucket[some]
        seed, start, size = ids[live] * _A, self.start[bucket], self.size[bucket]
        while len(live):
            if lev == len(_BOUNDS[self.least][0]):
                raise ValueError("names at more levels than counts have: the filter is full")
            hashed, at, here = mix(seed + np.uint64(lev * int(_B) % (1 << 64))), (start, size), None
            for j in range(HASHES):
                place = _bit(hashed, j, at[1]) + at[0]
                yes = np.flatnonzero(self.data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                here = yes if here is None else here[yes]
                if j + 1 < HASHES:
                    hashed, at = hashed[yes], (at[0][yes], at[1][yes])
            live, seed, start, size = live[here], seed[here], start[here], size[here]
            out[live] = lev
            lev += 1
        return out

    def levels_again(self, ids: np.ndarray) -> np.ndarray:
        """levels(ids), for names of which many come again and again."""
        names, found = self.known
        at = np.minimum(np.searchsorted(names, ids), max(len(names) - 1, 0))
        hit = names[at] == ids if len(names) else np.zeros(len(ids), bool)
        out = np.zeros(len(ids), np.int64)
        out[hit] = found[at[hit]]
        new = np.flatnonzero(~hit)
        out[new] = self.levels(ids[new])
        high = new[out[new] > 2]
        if len(high) and len(names) + len(high) <= KNOWN:
            names, found = np.r_[names, ids[high]], np.r_[found, out[high]]
            order = np.argsort(names)
            self.known = names[order], found[order]
        return out


def segment(ids: np.ndarray, count: np.ndarray, least: int, bits: float) -> np.ndarray:
    """A Bloom filter with all levels up to its own for each name."""
    lev = level(count, least)
    ids = np.repeat(ids, lev)
    steps = np.arange(len(ids)) - np.repeat(np.cumsum(lev) - lev, lev) + 1
    size = np.uint64(-(-int(len(ids) * bits) // 8) * 8)
    out, hashed = np.zeros(int(size), bool), mix(ids * _A + steps.astype(np.uint64) * _B)
    for j in range(HASHES):
        out[_bit(hashed, j, size).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


@dataclass
class Answers:
    """Levels of names, as the filters said where they lie."""

    least: int
    ids: np.ndarray
    found: np.ndarray

    def levels(self, ids: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.ids, ids)]

    levels_again = levels

def _pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    ids = np.zeros((len(raw), 8), np.uint8)
    ids[:, :6] = raw
    return ids.view("<u8").ravel()


def _collect(segments: DataFrame, least: int, shift: int, buckets: int) -> Filter:
    rows = segments.toArrow().sort_by("bucket")
    size = np.zeros(buckets, np.uint64)
    parts = [np.frombuffer(x.as_py(), np.uint8) for x in rows["data"]]
    if parts:
        size[rows["bucket"].to_numpy()] = [8 * len(p) for p in parts]
    start = np.cumsum(size, dtype=np.uint64) - size
    return Filter(least, shift, start, size, np.concatenate([*parts, np.zeros(1, np.uint8)]))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, block: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows as lists, tokens of them all, first token of each) for about `block` tokens at a time."""
    rows, texts, names, first, size = [], [], [], [], 0

    def name() -> int:
        nonlocal texts
        new, at = tokens(texts)
        first.append(at + sum(map(len, names)))
        names.append(new)
        texts = []
        return len(new)

    letters = 0
    for batch in batches:
        others = [batch[k].to_pylist() for k in range(batch.num_columns) if k != column]
        for k, text in enumerate(batch[column]):
            rows.append([o[k] for o in others])
            texts.append(text.as_py())
            letters += len(texts[-1] or "") + 8
            if letters < LETTERS:
                continue
            letters, size = 0, size + name()
            if size >= block:
                yield rows, np.concatenate(names), np.concatenate(first)
                rows, names, first, size = [], [], [], 0
    if texts:
        name()
    if rows:
        yield rows, np.concatenate(names), np.concatenate(first)


@dataclass
class Model:
    tokens: int
    kinds: int
    words: Filter | Answers
    pairs: Filter | Answers
    #: By level of the word before: the weight of the counts of pairs beside that of single words.
    trust: np.ndarray
    #: Filters too large to broadcast, as a written table (least, bucket, data); then words and pairs are empty.
    shelf: DataFrame | None = None

    def parts(self, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each token: its count at least, the level and count at most of the token before it, the count of both at least.

        So the shares of all tokens that follow one, and the shares of all single tokens, add up to 1 at most (but for names
        that the filters take for others).
        """
        code, kind = pd.factorize(names)
        lev = self.words.levels_again(single(kind))
        end = self.words.levels(single(np.array([END], np.uint64)))
        lev = lev[code]
        past = np.r_[end, lev[:-1]]
        past[first] = end[0]
        code, kind = pd.factorize(pairs(names, first))
        before = most_of(past, LEAST[1])
        both = np.minimum(least_of(self.pairs.levels(kind), LEAST[2])[code], before)
        return least_of(lev, LEAST[1]), np.minimum(past, LEVELS - 1), before, both

    def log10(self, names: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it."""
        count, past, before, both = self.parts(names, first)
        alone = (count + 1) / (self.tokens + self.kinds + 1)
        return np.log10(self.trust[past] * both / np.maximum(before, 1) + (1 - self.trust[past]) * alone)

    def left_out(self, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token of a training text: the level before it, and how many times likelier (a cell of log2) the pair
        counts make it than the single counts, both without this token. Cell 0: not at all."""
        count, past, before, both = self.parts(names, first)
        pair = np.where(both > 1, (both - 1) / np.maximum(before - 1, 1), 0.0)
        alone = np.maximum(count, 1) / (self.tokens + self.kinds)
        cell = np.clip(np.floor(2 * np.log2(np.maximum(pair, 1e-30) / alone)) + CELLS // 2, 1, CELLS - 1)
        return past, np.where(pair > 0, cell, 0).astype(np.int64)


def trusts(n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights that make n tokens by level and cell likeliest (expectation maximisation); 0 for a level without tokens."""
    ratio = np.r_[0.0, 2.0 ** ((np.arange(1, CELLS) - CELLS // 2 + 0.5) / 2)]
    trust = np.full(LEVELS, 0.5)
    for _ in range(rounds):
        own = trust[:, None] * ratio / (trust[:, None] * ratio + 1 - trust[:, None])
        trust = np.clip((n * own).sum(1) / np.maximum(n.sum(1), 1), 0, 0.999)
    return trust


def _numbered(letters: int):
    """Rows with the block of about so many letters, of their partition, that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, size = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            length = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
            past = size + np.cumsum(length) - length
            size += int(length.sum())
            yield pa.RecordBatch.from_arrays([pa.array(before + past // letters), *batch.columns], ["block", *batch.schema.names])

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows that are equal in all of names."""
    for batch in batches:
        same = np.zeros(max(batch.num_rows - 1, 0), bool)
        for x in names:
            value = batch[x].to_numpy()
            same |= value[1:] != value[:-1]
        cut = np.r_[0, np.flatnonzero(same) + 1, batch.num_rows].tolist()
        yield from (batch.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a)


def _asks(shift: int):
    """What the texts of a block ask of each bucket of the filters: rows (least, bucket, block, data), names of 6 bytes."""

    def put(block: int, texts: list) -> Iterator[pa.RecordBatch]:
        names, first = tokens(texts)
        for least, ids in ((LEAST[1], single(np.append(np.unique(names), np.uint64(END)))), (LEAST[2], pairs(names, first))):
            ids = np.unique(ids)
            bucket = (ids >> np.uint64(shift)).astype(np.int32)
            cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(ids)].tolist()
            data = pa.array([_pack(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            n = len(cut) - 1
            yield pa.record_batch({"least": np.full(n, least, np.int32), "bucket": bucket[cut[:-1]], "block": np.full(n, block), "data": data})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts = None, []
        for part in _groups(batches, ["block"]):
            block = part["block"][0].as_py()
            if block != last and texts:
                yield from put(last, texts)
                texts = []
            last = block
            texts += part["text"].to_pylist()
        if texts:
            yield from put(last, texts)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, its filter (block null) before what is asked of it; gives (block, least, data, found)."""
    at, own = None, None
    for part in _groups(batches, ["least", "bucket"]):
        here = part["least"][0].as_py(), part["bucket"][0].as_py()
        if here != at:
            at, own = here, None
        if part["block"][0].as_py() is None:
            data = np.frombuffer(part["data"][0].as_py(), np.uint8)
            own = Filter(here[0], 48, np.zeros(1, np.uint64), np.array([8 * len(data)], np.uint64), data)
            part = part.slice(1)
        if not part.num_rows:
            continue
        data = part["data"].to_pylist()
        ids, cut = _unpack(b"".join(data)), np.cumsum([len(x) // 6 for x in data])[:-1]
        found = own.levels(ids) if own else np.zeros(len(ids), np.int64)
        told = pa.array([x.astype("<u2").tobytes() for x in np.split(found, cut)], pa.binary())
        yield pa.RecordBatch.from_arrays([part["block"], part["least"], part["data"], told], ["block", "least", "data", "found"])


def _asked(rows: DataFrame, model: Model, letters: int) -> DataFrame:
    """rows, with text, in blocks sorted so that each begins with the answers of the filters to what it asks.

    A block asks for each of its names once, by shuffle to the bucket that knows it, and the answers go back in a second
    one; so no task holds more than one bucket's filter and a block's names, however large the corpus is.
    """
    buckets = len(model.words.size)
    shift = 48 - (buckets.bit_length() - 1)
    schema = "block long, " + ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    own = materialize(rows.mapInArrow(_numbered(letters), schema))
    asks = own.select("block", "text").mapInArrow(_asks(shift), "least int, bucket int, block long, data binary")
    asks = asks.unionByName(model.shelf.withColumn("block", F.lit(None).cast("long")))
    dealt = asks.repartition("least", "bucket").sortWithinPartitions("least", "bucket", F.asc_nulls_first("block"))
    told = dealt.mapInArrow(_answers, "block long, least int, data binary, found binary")
    both = told.unionByName(own, allowMissingColumns=True).select("block", "least", "data", "found", *rows.columns)
    return both.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("least"))


def _told(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[Model, list, np.ndarray, np.ndarray]]:
    """(model with the answers, rows as lists, tokens, first tokens) for each block of _asked."""
    last, answers, rows, texts = None, [], [], []

    def put():
        held = {}
        for least in LEAST.values():
            ids = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x) for k, x, _ in answers if k == least)])
            found = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<u2").astype(np.int64) for k, _, x in answers if k == least)])
            order = np.argsort(ids, kind="stable")
            held[least] = Answers(least, ids[order], found[order])
        return replace(model, words=held[LEAST[1]], pairs=held[LEAST[2]]), rows, *tokens(texts)

    for part in _groups(batches, ["block"]):
        block = part["block"][0].as_py()
        if block != last and rows:
            yield put()
        if block != last:
            last, answers, rows, texts = block, [], [], []
        others = [part[k].to_pylist() for k in range(4, part.num_columns) if part.schema.names[k] != "text"]
        for k, (least, data, found, text) in enumerate(zip(*(part[x].to_pylist() for x in ("least", "data", "found", "text")), strict=True)):
            if least is not None:
                answers.append((least, data, found))
            else:
                rows.append([o[k] for o in others])
                texts.append(text)
    if rows:
        yield put()


def _scored(batches: Iterator[pa.RecordBatch], model: Model, column: int, asked: bool) -> Iterator[tuple[Model, list, np.ndarray, np.ndarray]]:
    if asked:
        yield from _told(batches, model)
    else:
        yield from ((model, *x) for x in _blocks(batches, column, BLOCK))


def _neighbours(shift: int, buckets: int, block: int = BLOCK):
    """Pairs of each block of tokens as rows (bucket, ids, n): the ids of a bucket, each once, and how often each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, first in _blocks(batches, 0, block):
            ids, n = np.unique(pairs(names, first), return_counts=True)
            cut = np.searchsorted(ids, np.arange(buckets, dtype=np.uint64) << np.uint64(shift))
            cut = np.r_[cut, len(ids)]
            packed, times = _pack(ids), n.astype("<u4").tobytes()
            b = np.flatnonzero(np.diff(cut))
            of = [(cut[k], cut[k + 1]) for k in b.tolist()]
            data = [pa.array([x[w * i : w * j] for i, j in of], pa.binary()) for x, w in ((packed, 6), (times, 4))]
            yield pa.record_batch({"bucket": b.astype(np.int32), "ids": data[0], "n": data[1]})

    return run


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def fit(texts: DataFrame, most_bytes: int = MOST_BYTES, bucket: int = BUCKET) -> tuple[Model, DataFrame]:
    """The model of all texts (column text) and the exact counts (h, n) of their tokens as a written table.

    Words are counted by hash in Spark. Pairs of neighbours go, each once from a block of tokens with its count there, to
    buckets by their leading bits, where they are added up and become that bucket's part of the filter at once, pairs seen
    once too. Buckets follow the corpus in number, so each stays small. Finished filters of up to most_bytes come to the driver and are
    broadcast; larger ones stay a written table, and texts ask them by shuffle (_asked). The filters and so the scores are
    the same either way, BITS for each n-gram and level, however many there are. A filter that says yes to all raises.
    How far pairs are trusted is set last, in one more pass that scores each training token without itself.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, _ in _blocks(batches, 0, BLOCK):
            code, kind = pd.factorize(names)
            yield pa.record_batch({"h": kind.view(np.int64), "n": np.bincount(code, minlength=len(kind))})

    counts = materialize(texts.select("text").mapInArrow(words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    power = max(6, int(np.ceil(np.log2(max(1, total.n / bucket)))))
    shift, buckets = 48 - power, 1 << power

    def built(of_rows, least: int, bits: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            last = None
            for batch in batches:
                for k, x in of_rows(batch):
                    if k != last and last is not None:
                        yield put(last, held.pop(last))
                    held.setdefault(k, []).append(x)
                    last = k
            if last is not None:
                yield put(last, held.pop(last))

        def put(k: int, parts: list) -> pa.RecordBatch:
            ids, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            kind, of = np.unique(ids, return_inverse=True)
            data = segment(kind, np.bincount(of, n).astype(np.int64), least, bits)
            return pa.record_batch({"bucket": np.array([k], np.int32), "data": pa.array([data.tobytes()], pa.binary())})

        return run

    def packed(batch: pa.RecordBatch):
        for k, data, n in zip(batch["bucket"].to_pylist(), batch["ids"], batch["n"]):
            yield k, (_unpack(data.as_py()), np.frombuffer(n.as_py(), "<u4"))

    def counted(batch: pa.RecordBatch):
        b = batch["bucket"].to_numpy()
        ids, n = single(batch["h"].to_numpy().view(np.uint64)), batch["n"].to_numpy()
        cut = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if j > i:
                yield int(b[i]), (ids[i:j], n[i:j])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = single(batch["h"].to_numpy().view(np.uint64))
            yield pa.record_batch({"bucket": (ids >> np.uint64(shift)).astype(np.int32), "h": batch["h"], "n": batch["n"]})

    said = texts.select("text").mapInArrow(_neighbours(shift, buckets), "bucket int, ids binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    kept = counts.select("h", "n").mapInArrow(bucketed, "bucket int, h long, n long").repartition("bucket").sortWithinPartitions("bucket")
    one = materialize(kept.mapInArrow(built(counted, LEAST[1], BITS), "bucket int, data binary"))
    two = materialize(said.mapInArrow(built(packed, LEAST[2], BITS), "bucket int, data binary"))
    size = sum(x.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0] for x in (one, two))
    shelf = None
    if size > most_bytes:
        shelf = one.withColumn("least", F.lit(LEAST[1])).union(two.withColumn("least", F.lit(LEAST[2])))
        one, two = one.limit(0), two.limit(0)
    model = Model(total.n, total.v, _collect(one, LEAST[1], shift, buckets), _collect(two, LEAST[2], shift, buckets), np.zeros(LEVELS))
    sent = texts.sparkSession.sparkContext.broadcast(model)
    model.shelf = shelf
    asked = shelf is not None
    texts = _asked(texts.select("text"), model, SHARE) if asked else texts.select("text")

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(LEVELS * CELLS, np.int64)
        for own, _, names, first in _scored(batches, sent.value, 0, asked):
            past, cell = own.left_out(names, first)
            n += np.bincount(past * CELLS + cell, minlength=len(n))
        yield pa.record_batch({"cell": np.flatnonzero(n), "n": n[n > 0]})

    cells = texts.mapInArrow(ratios, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(LEVELS * CELLS)
    n[cells.cell.to_numpy(np.int64)] = cells.n
    model.trust = trusts(n.reshape(LEVELS, CELLS))
    return model, counts


def _apply(sent: Broadcast, head: Broadcast, asked: bool, kind_of_id: pa.DataType):
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", kind_of_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
        + [("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (frequent, logs), row = sent.value, head.value, TaskContext.get().partitionId() << 40
        for model, rows, names, first in _scored(batches, model, 2, asked):
            n = np.diff(np.r_[first, len(names)])
            doc = np.repeat(np.arange(len(rows)), n)
            score = np.bincount(doc, model.log10(names, first), len(rows))
            code, kind = pd.factorize(names)
            at = np.minimum(np.searchsorted(frequent, kind), max(len(frequent) - 1, 0))
            hit = frequent[at] == kind if len(frequent) else np.zeros(len(kind), bool)
            base = np.where(hit, logs[at] if len(frequent) else 0.0, 0.0)
            rare = np.flatnonzero(~hit[code])
            cell, times = np.unique(doc[rare] * len(kind) + code[rare], return_counts=True)
            cut = np.searchsorted(cell // len(kind), np.arange(len(rows) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (kind[cell % len(kind)].view(np.int64), times.astype(np.int32))]
            cols = [np.arange(row, row + len(rows)), pa.array([r[0] for r in rows], kind_of_id), [r[1] for r in rows], n]
            cols += [np.bincount(doc, hit[code], len(rows)).astype(np.int64), np.bincount(doc, base[code], len(rows)), score]
            row += len(rows)
            yield pa.record_batch([*map(pa.array, cols), *lists], schema=schema)

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """One row for each of docs (doc_id, held_out, text): n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are the end alone. The base score is exact: words frequent enough to be among the `head` most
    frequent are looked up in a broadcast array, each text's other words are joined with their counts and added up again.
    Repeated rows and null ids are scored like any other, an empty table gives no rows; doc_id may be of any type; other columns are
    not carried. A text is cut nowhere; about a block of tokens, or one longer text, is scored at once.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    grade = F.floor(F.log2("n") * 8)
    grades = counts.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect()
    taken, least = 0, None
    for g in grades:
        taken += g["count"]
        if taken > head:
            break
        least = g.g
    frequent = counts.where(grade >= least).toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    total = model.tokens + model.kinds + 1
    names = frequent["h"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    sent, asked = spark.sparkContext.broadcast(replace(model, shelf=None)), model.shelf is not None
    known = spark.sparkContext.broadcast((names[order], np.log10((frequent["n"].to_numpy()[order] + 1) / total)))
    docs = docs.select("doc_id", "held_out", "text")
    first = materialize(
        (_asked(docs, model, SHARE) if asked else docs).mapInArrow(
            _apply(sent, known, asked, to_arrow_type(id_type)),
            f"row long, doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>",
        )
    )
    rare = first.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    some = counts.where(grade < least) if least is not None else counts
    rare = rare.join(some, "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("more"),
        F.sum(F.col("t") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(total))).alias("rest"),
    )
    return first.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_bloomlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out().alias("held_out"))
    model, counts = fit(docs.where(~F.col("held_out")))
    return score(docs, model, counts)

"""Token ids as wavelet matrices: one bit-plane for each bit of an id, with counts that make rank and select short."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.llm.common import shared_dir, table
from brolga.llm.tokens import all_ids

#: Ids of a shard, but for a document that is longer; bits between two counts; bits of a kind between two entries for select.
SHARD = 1 << 19
BLOCK = 512
PICK = 4096
_WORDS = BLOCK // 64
_HEAD = "<4sHHHxxQ"
_SHARD_COLUMNS = ["part", "shard", "before", "n_tokens", "doc_ids", "doc_tokens", "wavelet"]


class WaveletMatrix:
    """A sequence of ids below 2**bits. Plane k has bit bits-1-k of each id, in the order that sorting by the planes above gives.

    File: "WVM2", bits, BLOCK, PICK, n; the zeros of each plane (64 bits each); then for each plane its bits, filled up
    beyond n to a whole BLOCK; the ones before every BLOCK and before the end (32 bits each); and for zeros and for ones
    the BLOCK in which every PICK-th of them lies (32 bits each), from which select starts.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray], picks: list[tuple[np.ndarray, np.ndarray]]):
        self.n, self.zeros, self.planes, self.ones, self.picks = n, zeros, planes, ones, picks

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        zeros, planes, ones, picks, ids = [], [], [], [], ids.astype(kind)
        blocks = len(ids) // BLOCK + 1
        for k in range(bits):
            bit = (ids & kind(1 << (bits - 1 - k))).astype(bool)
            packed = np.zeros(blocks * BLOCK // 8, np.uint8)
            packed[: -(-len(ids) // 8)] = np.packbits(bit, bitorder="little")
            planes.append(packed.view(np.uint64))
            count = np.bitwise_count(planes[-1]).reshape(-1, _WORDS).sum(1, dtype=np.int64)
            ones.append(np.r_[0, np.cumsum(count)].astype(np.uint32))
            low, high = ids[~bit], ids[bit]
            zeros.append(len(low))
            picks.append((cls._picks(BLOCK * np.arange(blocks + 1) - ones[-1], len(low)), cls._picks(ones[-1], len(high))))
            ids = np.concatenate([low, high])
        return cls(len(ids), zeros, planes, ones, picks)

    @staticmethod
    def _picks(before: np.ndarray, total: int) -> np.ndarray:
        return (np.searchsorted(before, np.arange(0, total, PICK), side="right") - 1).astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack(_HEAD, b"WVM2", len(self.planes), BLOCK, PICK, self.n) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(x.tobytes() for p, o, k in zip(self.planes, self.ones, self.picks, strict=True) for x in (p, o, *k))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, block, pick, n = struct.unpack_from(_HEAD, data)
        if (magic, block, pick) != (b"WVM2", BLOCK, PICK):
            raise ValueError("not a wavelet matrix file of this form")
        at, blocks = struct.calcsize(_HEAD), n // BLOCK + 1
        zeros, planes, ones, picks = np.frombuffer(data, "<u8", bits, at).tolist(), [], [], []
        at += 8 * bits

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            at += count * int(kind[-1])
            return np.frombuffer(data, kind, count, at - count * int(kind[-1]))

        for z in zeros:
            planes.append(take("<u8", blocks * _WORDS))
            ones.append(take("<u4", blocks + 1))
            picks.append((take("<u4", -(-z // PICK)), take("<u4", -(-(n - z) // PICK))))
        return cls(n, zeros, planes, ones, picks)

    def _block(self, k: int, block: np.ndarray) -> np.ndarray:
        return self.planes[k][block[:, None] * _WORDS + np.arange(_WORDS)]

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        block, word, inside = at // BLOCK, at // 64 % _WORDS, (at % 64).astype(np.uint64)
        words = self._block(k, block)
        full = np.where(np.arange(_WORDS) < word[:, None], np.bitwise_count(words), 0).sum(1, dtype=np.int64)
        last = words[np.arange(len(at)), word] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.ones[k][block].astype(np.int64) + full + np.bitwise_count(last)

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (from 0) bit of that value in plane k: two entries of the directory bound its block."""
        if not len(nth):
            return nth
        ones, picks = self.ones[k].astype(np.int64), self.picks[k][bit].astype(np.int64)
        low, high = picks[nth // PICK], np.append(picks, len(ones) - 2)[nth // PICK + 1]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            here = (ones[mid] if bit else mid * BLOCK - ones[mid]) <= nth
            low, high = np.where(here, mid, low), np.where(here, high, mid - 1)
        rest = nth - (ones[low] if bit else low * BLOCK - ones[low])
        words = self._block(k, low)
        words = words if bit else ~words
        past = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (past <= rest[:, None]).sum(1)
        row = np.arange(len(nth))
        rest -= np.where(word > 0, past[row, np.maximum(word, 1) - 1], 0)
        bits = np.unpackbits(words[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return low * BLOCK + word * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """ids at positions."""
        at = np.asarray(at, np.int64)
        ids = np.zeros(len(at), np.uint32)
        for k, zeros in enumerate(self.zeros):
            bit = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._rank(k, at)
            at = np.where(bit, zeros + ones, at - ones)
            ids = ids << np.uint32(1) | bit.astype(np.uint32)
        return ids

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        bounds = np.array([start, stop], np.int64)
        for k, zeros in enumerate(self.zeros):
            ones = self._rank(k, bounds)
            bounds = zeros + ones if token >> (len(self.zeros) - 1 - k) & 1 else bounds - ones
        return int(bounds[0]), int(bounds[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id stands at the positions from start to stop."""
        if token < 0 or token >> len(self.zeros):
            return 0
        low, high = self._range(token, start, self.n if stop is None else stop)
        return high - low

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The positions of an id, ascending."""
        if token < 0 or token >> len(self.zeros):
            return np.zeros(0, np.int64)
        low, high = self._range(token, start, self.n if stop is None else stop)
        at = np.arange(low, high)
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence, from the last plane up: each plane says where the two halves below it belong."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(out)
            up[~bit] = out[: self.zeros[k]]
            up[bit] = out[self.zeros[k] :] | kind(1 << (len(self.zeros) - 1 - k))
            out = up
        return out.astype(np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 0, bits: int = 16, shard: int = SHARD, encode: Callable | None = None) -> None:
    """Writes the ids of docs (doc_id, text), each followed by `end`, in ascending doc_id order as wavelet matrices.

    Null and empty texts are `end` alone. doc_id may be of any type that Spark can order; a null one sorts first; rows that
    share a doc_id are documents of their own, in the order of their texts. Rows are dealt to tasks by ranges of doc_id and
    sorted there; every task writes one Parquet file of shards (part, shard, before, n_tokens, doc_ids, doc_tokens, wavelet)
    through Spark's committer, so a lost task leaves nothing. A shard holds about `shard` ids, whole documents only, and an
    empty table has none. Ids must be below 2**bits. encode, if given, makes a worker's function from text to bytes of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, number, before = all_ids(tokenizer, encode), TaskContext.get().partitionId(), 0, 0
        names, sizes, held, total = [], [], [], 0

        def put() -> pa.RecordBatch:
            nonlocal number, before, names, sizes, held, total
            ids = np.concatenate(held)
            if int(ids.max()) >> bits:
                raise ValueError(f"an id does not fit {bits} bits")
            own, n = pa.concat_arrays(names), np.concatenate(sizes)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (own, pa.array(n))]
            data = pa.array([WaveletMatrix.of(ids, bits).to_bytes()], pa.binary())
            row = [np.array([x], t) for x, t in ((part, np.int32), (number, np.int32), (before, np.int64), (len(ids), np.int64))]
            number, before, names, sizes, held, total = number + 1, before + len(ids), [], [], [], 0
            return pa.RecordBatch.from_arrays([*map(pa.array, row), *lists, data], _SHARD_COLUMNS)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = ids_of(batch[1])
            ids = np.insert(ids, np.cumsum(n), end)
            n = n + 1
            stop, done = np.cumsum(n), 0
            while done < len(n):
                past = int(stop[done] - n[done])
                to = min(int(np.searchsorted(stop, past + shard - total)) + 1, len(n))
                names.append(batch[0].slice(done, to - done))
                sizes.append(n[done:to])
                held.append(ids[past : stop[to - 1]])
                total, done = total + len(held[-1]), to
                if total >= shard:
                    yield put()
        if names:
            yield put()

    key, kind = F.xxhash64("text"), docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key, "text")
    shards = dealt.mapInArrow(run, f"part int, shard int, before long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, wavelet binary")
    shards.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Shards of written files with `start`: the ids of all documents before the shard."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    past = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(past, F.lit(0)).alias("past"))
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("past") + F.col("before")).drop("past")


def documents_of(shards: DataFrame) -> DataFrame:
    """One row for each document of read_ids(): doc_id, start, n_tokens, ids_crc32 of its ids as they are in the file."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, sizes, wavelet in zip(*batch.columns):
                data = memoryview(WaveletMatrix.from_bytes(wavelet.as_py()).ids().astype("<u4").tobytes())
                sizes = sizes.values.to_numpy()
                at = np.cumsum(sizes) - sizes
                sums = [zlib.crc32(data[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                cols = [names.values, pa.array(at + start.as_py()), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("start", "doc_ids", "doc_tokens", "wavelet").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def count(shards: DataFrame, tokens: list[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """(token, n): how often each of a stated list of ids stands at the positions of read_ids() from start to stop.

    Each shard in that stretch answers from its planes by two ranks a plane; only sums are shuffled. Ids nowhere have 0.
    """
    tokens = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for at, wavelet in zip(batch[0].to_pylist(), batch[1]):
                own = WaveletMatrix.from_bytes(wavelet.as_py())
                low, high = max(0, start - at), own.n if stop is None else min(own.n, stop - at)
                n += [own.count(t, low, high) for t in tokens]
        yield pa.record_batch({"token": np.array(tokens, np.int64), "n": n})

    return _within(shards, start, stop).select("start", "wavelet").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, tokens: list[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """(token, position, doc_id, at): every place of a stated list of ids from start to stop, and where it lies in its document.

    Each shard finds its own places by select; nothing is shuffled.
    """
    tokens = sorted(set(tokens))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, names, sizes, wavelet in zip(*batch.columns):
                own, first = WaveletMatrix.from_bytes(wavelet.as_py()), first.as_py()
                low, high = max(0, start - first), own.n if stop is None else min(own.n, stop - first)
                ends = np.cumsum(sizes.values.to_numpy())
                for token in tokens:
                    at = own.occurrences(token, low, high)
                    doc = np.searchsorted(ends, at, side="right")
                    inside = at - np.r_[0, ends][doc]
                    cols = [np.full(len(at), token, np.int64), at + first, names.values.take(pa.array(doc)), inside]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["token", "position", "doc_id", "at"])

    of = _within(shards, start, stop).select("start", "doc_ids", "doc_tokens", "wavelet")
    return of.mapInArrow(run, f"token long, position long, doc_id {kind}, at long")


def access(shards: DataFrame, positions: DataFrame, cell: int = SHARD) -> DataFrame:
    """(position, token) for each different position (a long column) of a table that lies within read_ids().

    Positions meet their shard by equality on cells of so many ids, and a shard gets its own, each once: at most its length.
    """
    mine = positions.select("position").where("position is not null").distinct().withColumn("_cell", F.floor(F.col("position") / cell))
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("n_tokens") - 1) / cell)))
    spans = shards.select("part", "shard", "start", "n_tokens", cells.alias("_cell"))
    asked = mine.join(spans, "_cell").where("position >= start and position < start + n_tokens").select("part", "shard", "position")

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not (data.num_rows and asked.num_rows):
            return pa.table({"position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        at = asked["position"].to_numpy()
        own = WaveletMatrix.from_bytes(data["wavelet"][0].as_py())
        return pa.table({"position": at, "token": own.access(at - data["start"][0].as_py()).astype(np.int64)})

    held = shards.select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), "start", "wavelet").groupBy("_part", "_shard")
    return held.cogroup(asked.groupBy("part", "shard")).applyInArrow(run, "position long, token long")


def _within(shards: DataFrame, start: int, stop: int | None) -> DataFrame:
    some = shards.where(F.col("start") + F.col("n_tokens") > start)
    return some if stop is None else some.where(F.col("start") < stop)


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return documents_of(read_ids(spark, path))

"""Hierarchical packing: remainders of documents go to context-size tiers, long windows fill their gaps from shorter tiers."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from brolga.llm.common import table
from brolga.llm.tokens import all_ids

TIERS = (2048, 1024, 512, 256)
#: Ids that are packed together, and ids of a step group.
POOL = 1 << 20
STEP = 1 << 17
END = 1

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, step_group long"
)


class Packer:
    """Packs documents of one partition. A piece is (length, number of document, start); pieces wait sorted in their tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
        #: Ids that wait in each tier.
        self.sums = [0] * len(tiers)

    def route(self, piece: tuple[int, int, int]) -> None:
        """A piece waits in the smallest tier that holds it whole."""
        k = 0
        while k + 1 < len(self.tiers) and piece[0] <= self.tiers[k + 1]:
            k += 1
        insort(self.waiting[k], piece)
        self.sums[k] += piece[0]

    def take(self, k: int, at: int) -> tuple[int, int, int]:
        piece = self.waiting[k].pop(at)
        self.sums[k] -= piece[0]
        return piece

    def add(self, doc: int, n: int) -> list[list[tuple[int, int, int]]]:
        """Full windows cut from a document; its remainder waits."""
        window = self.tiers[0]
        full = [[(window, doc, at)] for at in range(0, n - window + 1, window)]
        if n % window:
            self.route((n % window, doc, n - n % window))
        return full

    def fill(self, pieces: list[tuple[int, int, int]], gap: int, tier: int) -> int:
        """Takes pieces for a gap from the tier and the shorter ones: whole ones, the longest first, then a cut one."""
        while gap:
            best = None
            for k in range(tier, len(self.tiers)):
                at = bisect_right(self.waiting[k], (gap, 1 << 62, 0)) - 1
                if at >= 0 and (best is None or self.waiting[k][at][0] > self.waiting[best[0]][best[1]][0]):
                    best = k, at
            if best is not None:
                piece = self.take(*best)
            else:
                k = next((k for k in range(len(self.tiers) - 1, tier - 1, -1) if self.waiting[k]), None)
                if k is None:
                    return gap
                n, doc, start = self.take(k, 0)
                self.route((n - gap, doc, start + gap))
                piece = (gap, doc, start)
            pieces.append(piece)
            gap -= piece[0]
        return 0

    def full(self) -> Iterator[list[tuple[int, int, int]]]:
        """Packs what waits into full windows of the tiers, longest tier first; what cannot fill one more goes on waiting."""
        for k, size in enumerate(self.tiers):
            while self.waiting[k]:
                if sum(self.sums[k:]) < size:
                    break
                pieces = [self.take(k, -1)]
                self.fill(pieces, size - pieces[0][0], k)
                yield pieces

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """At the end: what still waits, in full windows as long as it fills one, then in a last one that is padded."""
        for k, size in enumerate(self.tiers):
            while sum(self.sums) >= size:
                pieces: list[tuple[int, int, int]] = []
                self.fill(pieces, size, 0)
                yield pieces
        if last := [p for w in self.waiting for p in w]:
            self.waiting, self.sums = [[] for _ in self.tiers], [0] * len(self.tiers)
            yield last


def step_groups(lengths: list[int], step: int) -> list[int]:
    """A group for each sequence so that groups hold about `step` ids and as even sums as the longest-first rule gives."""
    heap = [(0, g) for g in range(max(1, round(sum(lengths) / step)))]
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (n + lengths[k], g))
    return out


def _rows(docs: Iterator[tuple[object, np.ndarray]], part: int, tiers: tuple[int, ...], pool: int, step: int, with_ids: bool) -> Iterator[dict]:
    packer, kept, made, held, number, sequence, groups = Packer(tiers), {}, [], 0, 0, part << 32, part << 32

    def put() -> dict:
        nonlocal sequence, groups, made
        cols: dict = {n.split()[0]: [] for n in SCHEMA.split(",")} | ({"ids": []} if with_ids else {})
        lengths = [sum(p[0] for p in pieces) for pieces in made]
        of = step_groups(lengths, step)
        for pieces, n, g in zip(made, lengths, of, strict=True):
            at, tier = 0, n if n in tiers else max(tiers)
            for length, doc, start in pieces:
                doc_id, ids = kept[doc]
                mine = memoryview(ids[start : start + length])
                row = (doc_id, start, length, zlib.crc32(mine), len(ids), sequence, at, tier, groups + g, bytes(mine) if with_ids else b"")
                for col, x in zip(cols.values(), row):
                    col.append(x)
                at += length
            sequence += 1
        groups += max(of, default=-1) + 1
        made = []
        waiting = {p[1] for w in packer.waiting for p in w}
        for doc in [d for d in kept if d not in waiting]:
            del kept[doc]
        return cols

    for doc_id, ids in docs:
        kept[number] = doc_id, ids
        made += packer.add(number, len(ids))
        held += max(len(ids), 16)
        number += 1
        if held >= pool:
            made += packer.full()
            yield put()
            held = 0
    made += packer.full()
    made += packer.rest()
    yield put()


def pack(
    docs: DataFrame,
    path: str,
    encode: Callable[[str], Callable[[str | None], bytes]] | None = None,
    end: int = END,
    tiers: tuple[int, ...] = TIERS,
    pool: int = POOL,
    step: int = STEP,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence (SCHEMA; ids if asked for).

    A document is its ids and `end`; null and empty texts are `end` alone. Whole windows of the longest tier are cut from a
    document, the remainder goes to the smallest tier that holds it. Tiers are packed from the longest on: a window opens
    with the longest remainder of its tier, and its gap is filled from the same and the shorter tiers, by whole pieces as
    long as one fits and then by cutting one. So sequences are full windows of a tier (a power of two), but for the last
    one of a partition. Step groups hold about `step` ids each, evenly, and never mix partitions. Documents stay in the
    task that reads them: nothing is shuffled, a task holds `pool` ids and the remainders that wait. Repeated rows are
    documents of their own; doc_id may be of any type, a null one is kept. Sequence ids start at the partition's number times 2**32.
    path names a file of the tokenizers library; encode, if given, makes another encoder of the worker from it.
    """
    tail, kind = np.array([end], np.uint32), docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}") + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, own = all_ids(path, encode), TaskContext.get().partitionId(), None

        def found() -> Iterator[tuple[object, np.ndarray]]:
            nonlocal own
            for batch in batches:
                own = batch.schema.field(0).type
                ids, n = ids_of(batch[1])
                stop = np.cumsum(n)
                for doc_id, a, b in zip(batch[0].to_pylist(), (stop - n).tolist(), stop.tolist(), strict=True):
                    yield doc_id, np.concatenate([ids[a:b], tail]).astype("<u4", copy=False)

        for cols in _rows(found(), part, tiers, pool, step, with_ids):
            if cols["doc_id"]:
                kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
                types = [own, *(kinds[x.split()[1]] for x in schema.split(",")[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types, strict=True)], list(cols))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

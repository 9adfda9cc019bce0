"""Substring dedup by recompression: runs and pairs of words get names round by round, and long repeats show as shared names."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brolga.llm.common import materialize, release, shared_dir, small_batches, table, worker_cache
from brolga.llm.flat import edges_of, flat

WINDOW = 35
#: Letters of the documents that are named together, and of those in one file of the dealt table.
LETTERS, FILE = 1 << 21, 1 << 25
#: A block's letters are so large a part of all, but for LETTERS at least and MOST at most; what is asked of one bucket comes from MEET
#: letters at least and MEETS at most.
PART, MOST, MEET, MEETS = 1 << 9, 1 << 25, 1 << 24, 1 << 27
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BLOCK = "_recompress_block"
ADDED = "n_words long, n_removed long, kept_text string, kept_sha256 string"
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def level_for(window: int) -> int:
    """The level of the symbols that are asked for: a window has room for some of them with all that decides them, mostly."""
    return max(0, int(window).bit_length() - 2)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Symbols:
    """Symbols of a level: name, first word and the one behind the last, and first and last of the words that decide them.

    A symbol is the same wherever the words from `low` to `high` are the same; symbols of which that is not known, as a
    document ends too soon, have bounds that no window holds.
    """

    def __init__(self, names: np.ndarray, doc: np.ndarray, window: int):
        self.doc, self.window, self.level = doc, window, 0
        self.names, self.start = names, np.arange(len(names))
        self.stop = self.start + 1
        self.low, self.high = self.start, self.stop

    def _take(self, names: np.ndarray, keep: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.names, self.start, self.stop, self.low, self.high = names[keep], self.start[keep], stop[keep], low[keep], high[keep]

    def fold_runs(self) -> None:
        """Every run of equal words, however long, becomes one symbol, named by word and length; the words beside it decide where it ends."""
        if not len(self.names):
            return
        new = np.r_[True, (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(self.names)])
        names = self.names.copy()
        names[first] = np.where(size > 1, mix(names[first] * _A + size.astype(np.uint64) * _C), names[first])
        stop = self.stop.copy()
        stop[first] = first + size
        self._take(names, first, stop, self.start - 1, stop + 1)
        edge = np.r_[-1, self.doc, -1]
        self.low = np.where(edge[self.start] != self.doc[self.start], self.start - self.window, self.low)
        self.high = np.where(edge[self.stop + 1] != self.doc[self.start], self.stop + self.window, self.high)

    def join_pairs(self) -> None:
        """Every symbol is a left or a right one by a hash of its name; a left one with a right one behind it becomes a pair,
        named by both. So what becomes of a symbol is decided by itself and one neighbour."""
        self.level += 1
        n = len(self.names)
        if not n:
            return
        right = (mix(self.names + np.uint64(self.level * int(_A) % (1 << 64))) & np.uint64(1)).astype(bool)
        of = self.doc[self.start]
        follows = np.r_[of[1:] == of[:-1], False]
        pair = ~right & np.r_[right[1:], False] & follows
        behind, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        other = np.where(right, before, behind)
        known = np.where(right, np.r_[False, follows[:-1]], follows)
        low = np.where(known, np.minimum(self.low, self.low[other]), self.start - self.window)
        high = np.where(known, np.maximum(self.high, self.high[other]), self.stop + self.window)
        names = np.where(pair, mix(self.names * _A + self.names[behind] * _B + np.uint64(self.level)), self.names)
        stop = np.where(pair, self.stop[behind], self.stop)
        self._take(names, ~np.r_[False, pair[:-1]], stop, low, high)

    def rise(self, level: int) -> None:
        if level and not self.level:
            self.fold_runs()
        while self.level < level:
            self.join_pairs()

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the first window that holds all that decides it, and the one behind the last."""
        low = np.clip(self.high - self.window, 0, len(self.doc))
        return low, np.maximum(low, np.clip(self.low + 1, 0, len(self.doc)))


class Block:
    """The words of some documents, and which of their windows may still stand elsewhere too.

    Words are named by a hash of all their bytes. Level 1 folds runs and joins pairs, each further level joins pairs again. As
    long as every symbol that a window decides stands twice in the corpus, the window is live; the last question is for
    the words of the live windows.
    """

    def __init__(self, texts: pa.Array, window: int):
        data, bounds = flat(texts)
        inside = _WORD[data]
        first, last = edges_of(inside, bounds)
        self.window, size, total = window, last - first, len(first)
        text = np.searchsorted(bounds, first, "right") - 1
        self.sizes = np.bincount(text, minlength=len(texts))
        letters = data[inside].astype(np.uint64) + np.uint64(1)
        start = np.cumsum(size) - size
        letters *= _powers(_A, int(size.max(initial=0)))[np.arange(len(letters)) - np.repeat(start, size)]
        self.words = mix(np.add.reduceat(letters, start)) if total else np.zeros(0, np.uint64)
        self.doc = text
        self.live = np.arange(total) + window <= np.repeat(np.cumsum(self.sizes), self.sizes)
        self.symbols = Symbols(self.words, self.doc, window)

    def names(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(48-bit names, whether more than once here) of the different symbols that live windows decide, ascending."""
        self.symbols.rise(level)
        low, high = self.symbols.windows()
        alive = np.r_[0, np.cumsum(self.live)]
        asked = np.flatnonzero(alive[high] > alive[low])
        self.low, self.high = low[asked], high[asked]
        names, self.of, n = np.unique(self.symbols.names[asked] >> np.uint64(16), return_inverse=True, return_counts=True)
        return names, n > 1

    def drop(self, shared: np.ndarray) -> None:
        """Windows die that decide a symbol which stands once, of those that names() gave last."""
        once = ~shared[self.of]
        dead = np.bincount(self.low[once], minlength=len(self.doc) + 1) - np.bincount(self.high[once], minlength=len(self.doc) + 1)
        self.live &= np.cumsum(dead)[:-1] == 0

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """(128-bit digests as two numbers each, whether more than once here) of the different live windows, ascending.

        Both numbers are polynomials in the names of a window's words, from differences of running sums.
        """
        place, sums = np.flatnonzero(self.live), []
        for base in (_B, _C):
            back = np.uint64(pow(int(base), -1, 1 << 64))
            run = np.r_[np.uint64(0), np.cumsum(mix(self.words + base) * _powers(base, len(self.words)), dtype=np.uint64)]
            sums.append(mix((run[place + self.window] - run[place]) * _powers(back, len(self.words))[place]))
        all_ = np.stack(sums, 1) if len(place) else np.zeros((0, 2), np.uint64)
        found, self.of, n = _different(all_)
        return found, n > 1

    def removed(self, shared: np.ndarray) -> list[np.ndarray]:
        """For each document the words that a window covers which stands elsewhere too, of those that digests() gave last."""
        hit = np.flatnonzero(self.live)[shared[self.of]]
        cover = np.bincount(hit, minlength=len(self.doc) + 1) - np.bincount(hit + self.window, minlength=len(self.doc) + 1)
        return np.split(np.cumsum(cover)[:-1] > 0, np.cumsum(self.sizes)[:-1])


def _different(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows of two numbers, ascending; which of them each row is; and how often each stands."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    ranked = rows[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(1)] if len(order) else np.zeros(0, bool)
    of = np.zeros(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return ranked[new], of, np.bincount(of, minlength=int(new.sum()))


def _parts(own: pa.Table, letters: int) -> list[pa.Array]:
    """The texts of a block, about so many letters at a time."""
    texts = own["text"].combine_chunks() if own.num_rows else pa.array([], pa.string())
    total = np.cumsum(np.diff(flat(texts)[1]))
    cut = np.unique(np.r_[0, np.flatnonzero(np.diff(total // letters)) + 1, len(texts)]).tolist()
    return [texts.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _clear() -> None:
    """Before a block: what other operators keep in the worker goes, and so does the memory of the block before."""
    worker_cache("recompress")
    release()


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("names", pa.binary()), ("many", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("shared", pa.bool_()), ("names", pa.binary())])
#: The question for whole windows, after that for symbols.
LAST = 99


def _pack(names: np.ndarray) -> bytes:
    return names.astype("<u8").tobytes() if names.ndim == 2 else names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(data, "<u8").reshape(-1, 2)
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    names = np.zeros((len(raw), 8), np.uint8)
    names[:, :6] = raw
    return names.view("<u8").ravel()


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of names."""
    lead = names[:, 0] >> np.uint64(16) if names.ndim == 2 else names
    return ((lead >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _asks(block: int, found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """What a block asks of each bucket: the different names of its parts, and a bit for each whether it stands twice in the block."""
    if not found:
        return _ASK.empty_table()
    names, many = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        if names.ndim == 2:
            names, of, n = _different(names)
        else:
            names, of, n = np.unique(names, return_inverse=True, return_counts=True)
        many = (n > 1) | (np.bincount(of, many, len(n)) > 0)
    bucket = _bucket(names, buckets)
    cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(names)].tolist() if len(names) else [0]
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    cols = [bucket[cut[:-1]].astype(np.int32), np.full(len(spans), block, np.int64), np.diff(cut).astype(np.int32)]
    cols += [[_pack(names[a:b]) for a, b in spans], [np.packbits(many[a:b], bitorder="little").tobytes() for a, b in spans]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _ASK.types, strict=True)], schema=_ASK)


def _share(level: int):
    """All that is asked of one bucket: to each block the names that others ask for too, or that stand twice in it, or else the
    other names, whichever are fewer."""

    def run(asked: pa.Table) -> pa.Table:
        size = asked["n"].to_numpy().astype(np.int64)
        names = _unpack(b"".join(asked["names"].to_pylist()), level == LAST)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n, bitorder="little").astype(bool) for m, n in zip(asked["many"].to_pylist(), size.tolist(), strict=True)])
        _, of, _ = _different(names) if level == LAST else np.unique(names, return_inverse=True, return_counts=True)
        shared = (np.bincount(of, 1 + many.astype(np.int64)) > 1)[of]
        told, cut = [], np.r_[0, np.cumsum(size)].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = shared[a:b]
            which = 2 * int(own.sum()) <= len(own)
            told.append((which, _pack(names[a:b][own == which])))
        cols = [asked["block"], np.full(len(size), level, np.int32), asked["bucket"], pa.array([x[0] for x in told], pa.bool_()), pa.array([x[1] for x in told], pa.binary())]
        return pa.table(cols, schema=_TOLD)

    return run


class Told:
    """What the buckets said of one block's names of a level."""

    def __init__(self, answers: pa.Table, level: int, buckets: int):
        rows = sorted((b, s, x) for k, b, s, x in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "shared", "names")), strict=True) if k == level)
        self.some, self.buckets = bool(rows), buckets
        self.which = np.zeros(buckets, bool)
        self.which[[b for b, _, _ in rows]] = [s for _, s, _ in rows]
        self.listed = _unpack(b"".join(x for _, _, x in rows), level == LAST)

    def shared(self, names: np.ndarray) -> np.ndarray:
        """Whether each of names, which were asked for, stands anywhere else."""
        wide, hit = names.ndim == 2, np.zeros(len(names), bool)
        lead, own = (self.listed[:, 0], names[:, 0]) if wide else (self.listed, names)
        at, open_ = np.searchsorted(lead, own), np.arange(len(names))
        while len(open_):
            open_ = open_[at[open_] < len(lead)]
            open_ = open_[lead[at[open_]] == own[open_]]
            found = (self.listed[at[open_], 1] == names[open_, 1]) if wide else np.ones(len(open_), bool)
            hit[open_[found]] = True
            open_ = open_[~found]
            at[open_] += 1
        return hit == self.which[_bucket(names, self.buckets)]


def _dealt(docs: DataFrame, letters: int, total: int) -> DataFrame:
    """docs with the number of a block, of about so many letters, as a written table whose files hold whole blocks.

    Later rounds so read their texts where they lie: only questions and answers travel. Spark knows that of bucketed tables
    only, and writes these by name; the name goes at once, the files lie in the shared folder. Copies are dealt out by
    their doc_id, repeated rows by the partition that they come from.
    """
    spark = docs.sparkSession
    blocks = 1 + total // letters
    files = int(min(blocks, 1 + total // max(min(FILE, 16 * letters), letters), 1 << 16))
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    name = f"brolga_{uuid.uuid4().hex}"
    docs.withColumn(_BLOCK, block).repartition(files, _BLOCK).write.bucketBy(files, _BLOCK).option("path", shared_dir(spark)).saveAsTable(name)
    own = spark.table(name)
    own.schema  # noqa: B018 - resolved before the name goes; the files stay
    spark.sql(f"drop table {name}")
    return own


def dedup_substrings(docs: DataFrame, window: int = WINDOW, letters: int | None = None, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_text and kept_sha256 added (columns of these names go; no kept_text if not with_text).

    A word is removed if `window` consecutive words around it stand, as the same sequence, at another place too, in the
    same document or any other; all places lose it. Kept words are joined by one space. Null, empty and short texts have
    nothing to remove (null: no words), an empty table has no rows. Repeated rows are documents of their own and so remove
    each other's windows; a null doc_id is a value like any other. Other columns pass through.

    Two rounds of Spark jobs follow the naming of runs and pairs, level by level, inside blocks of documents: each block asks
    once for each name of the highest level whether it stands anywhere else, and windows with a name that does not are out;
    then for the words of each window left, by a 128-bit digest of them, and that alone decides. Names are hashes of what
    they stand for, so they are the same in the whole corpus; should two contents share one, a window stays in longer than
    it need. A block asks for a name once however often it stands there, so a passage that all documents share comes
    once from a block. Blocks and buckets grow with the corpus up to a bound (`letters` fixes those of a block), so that
    what is shuffled for a name stays nearly the same; inside a block LETTERS are worked on at a time.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*(x.split()[0] for x in ADDED.split(", ")), _BLOCK)
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    meet = max(MEET, min(MEETS, total // 64)) if letters is None else 16 * letters
    letters = letters or max(LETTERS, min(MOST, total // PART))
    at_once = min(letters, LETTERS)
    own = _dealt(docs, letters, total)
    buckets, level = int(min(1 << 20, max(32, 1 + total // meet))), level_for(window)
    texts = own.select(_BLOCK, "text")

    def first(own: pa.Table) -> pa.Table:
        _clear()
        return _asks(own[_BLOCK][0].as_py(), [Block(x, window).names(level) for x in _parts(own, at_once)], buckets)

    def live(text: pa.Array, told: Told) -> Block:
        block = Block(text, window)
        names, _ = block.names(level)
        block.drop(told.shared(names))
        return block

    def second(own: pa.Table, told: pa.Table) -> pa.Table:
        _clear()
        if not (own.num_rows and told.num_rows):
            return _ASK.empty_table()
        of = Told(told, level, buckets)
        return _asks(own[_BLOCK][0].as_py(), [live(x, of).digests() for x in _parts(own, at_once)], buckets)

    ask, tell = "bucket int, block long, n int, names binary, many binary", "block long, level int, bucket int, shared boolean, names binary"
    symbols = materialize(texts.groupBy(_BLOCK).applyInArrow(first, ask).groupBy("bucket").applyInArrow(_share(level), tell))
    asked = texts.groupBy(_BLOCK).cogroup(symbols.groupBy("block")).applyInArrow(second, ask)
    both = symbols.union(materialize(asked.groupBy("bucket").applyInArrow(_share(LAST), tell)))

    added = [x.strip() for x in ADDED.split(",") if with_text or "kept_text" not in x]
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in map(str.split, added)])

    def cut(own: pa.Table, told: pa.Table) -> pa.Table:
        _clear()
        out = own.drop_columns(_BLOCK)
        if not own.num_rows:
            return out.append_column(kinds.field(0), pa.array([], kinds.field(0).type))  # no such group
        of, last = Told(told, level, buckets), Told(told, LAST, buckets)
        cols: dict[str, list] = {x.split()[0]: [] for x in ADDED.split(", ")}
        for part in _parts(own, at_once):
            gone = [None] * len(part)
            if last.some:
                block = live(part, of)
                names, _ = block.digests()
                gone = block.removed(last.shared(names))
            for text, lost in zip(part.to_pylist(), gone, strict=True):
                words = text.encode().split() if text else []
                removed = 0 if lost is None else int(lost.sum())
                kept = b" ".join([w for w, g in zip(words, lost.tolist(), strict=True) if not g] if removed else words)
                for col, x in zip(cols.values(), (len(words), removed, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(x)
        for f in kinds:
            out = out.append_column(f, pa.array(cols[f.name], f.type))
        return out

    out = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + added)
    return own.groupBy(_BLOCK).cogroup(both.groupBy("block")).applyInArrow(cut, out)


def op9_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of `dedup_substrings` for all `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, p, array_to_string(w[p : p + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as p from d where len(w) >= 35)),
dup as (select r, p from (select r, p, count(*) over (partition by s) as n from win) where n > 1),
gone as (select distinct r, unnest(range(p, p + 35)) as q from dup),
tok as (select r, unnest(w) as t, unnest(range(1, len(w) + 1)) as q from d),
kept as (select tok.r, count(gone.q) as n_removed, string_agg(case when gone.q is null then t end, ' ' order by tok.q) as k
         from tok left join gone on gone.r = tok.r and gone.q = tok.q group by tok.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (r)
"""

"""Importance resampling towards a target: hashed word n-grams of a batch of texts, counted in one pass over all of them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.llm.common import materialize, release, small_batches, table, worker_cache

BUCKETS = 10_000
#: Percent of the documents with LEAST_WORDS words that are drawn.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Bytes of texts that are joined; a longer text is cut between words, and its last two words go on in front of the next part.
TOGETHER = 1 << 21

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: No part of any word, so it parts the texts of a batch.
_SENTINEL = b"\x00"
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_step() -> np.ndarray:
    """[byte of the state, its value]: what a CRC-32 state becomes by a zero byte more."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    state = np.arange(256, dtype=np.uint32)
    rest = [state << np.uint32(8 * (k - 1)) if k else table for k in range(4)]
    return np.stack(rest)


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states after as many zero bytes as the tables are for; tables may be one for each state in front."""
    low = np.uint32(255)
    return tables[0][state & low] ^ tables[1][state >> np.uint32(8) & low] ^ tables[2][state >> np.uint32(16) & low] ^ tables[3][state >> np.uint32(24)]


def _zeros(n: int) -> np.ndarray:
    """Tables for n zero bytes, by squaring."""
    out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    power = _byte_step()
    while n:
        if n & 1:
            out = _apply(power, out)
        power, n = _apply(power, power), n >> 1
    return out


def _followed(state: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from that of the first, the length of the second and the CRC-32 of the second."""
    sizes, which = np.unique(size, return_inverse=True)
    kept = worker_cache("resample")
    tables = np.empty((4, len(sizes) * 256), np.uint32)
    for k, n in enumerate(sizes.tolist()):
        if n not in kept:
            if len(kept) > 4096:
                kept.clear()
            kept[n] = _zeros(n)
        tables[:, k * 256 : k * 256 + 256] = kept[n]
    at, low = (which * 256).astype(np.uint32), np.uint32(255)
    out = tables[0][at + (state & low)]
    for k in (1, 2, 3):
        out ^= tables[k][at + (state >> np.uint32(8 * k) & low)]
    return out ^ tail


def _joined(texts: Iterator[str | None], most: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of texts in lower case, joined: bytes, where each part begins, its text, and its words that were in the part before."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0

    def together() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        begin = np.cumsum([0] + [len(p[0]) + 1 for p in parts[:-1]])
        return _SENTINEL.join(p[0] for p in parts), begin, np.array([p[1] for p in parts]), np.array([p[2] for p in parts])

    for n, text in enumerate(texts):
        rest, carried = (text or "").encode().lower(), []
        at = 0
        while True:
            gap = _GAP.search(rest, at + most) if len(rest) - at > most else None
            piece = rest[at : gap.start()] if gap else rest[at:]
            if size and size + len(piece) > most:
                yield together()
                parts, size = [], 0
            head = b" ".join([*carried, piece])
            parts.append((head, n, len(carried)))
            size += len(head) + 1
            if not gap:
                break
            carried = (carried + _WORD.findall(piece))[-2:]
            at = gap.start()
    if parts:
        yield together()


def _grams(data: bytes, begin: np.ndarray, carried: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(part of each word; for each n up to order CRC-32 of the n words that end there, and whether they count).

    Words are found by one regular expression over all parts together; the place of a word tells its part, and what reaches
    over the beginning of a part, or ends in a word that the part before had, is masked.
    """
    spans = np.fromiter(chain.from_iterable(m.span() for m in _WORD.finditer(data)), np.int64).reshape(-1, 2)
    size = spans[:, 1] - spans[:, 0]
    letters = np.frombuffer(data, np.uint8)
    letters = letters[_IN_WORD[letters]]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    code, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    alone = np.fromiter(map(zlib.crc32, different), np.uint32, len(different))[code]
    after = np.fromiter((zlib.crc32(b" " + w) for w in different), np.uint32, len(different))[code]
    part = np.searchsorted(begin, spans[:, 0], "right") - 1
    place = np.arange(len(part)) - np.searchsorted(part, np.arange(len(begin)))[part]
    own = place >= carried[part]
    out, counts = [alone], [own]
    for n in range(1, order):
        longer = np.zeros_like(alone)
        if len(alone) > n:
            longer[n:] = _followed(out[-1][n - 1 : -1], size[n:] + 1, after[n:])
        out.append(longer)
        counts.append(own & (place >= n))
    return part, out, counts


def _histogram(buckets: int, order: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, begin, _, carried in _joined(batch.column(0).to_pylist(), most):
                _, grams, counts = _grams(data, begin, carried, order)
                for crc, counted in zip(grams, counts):
                    total += np.bincount(crc[counted] % np.uint32(buckets), minlength=buckets)
            release()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = 3, most: int = TOGETHER) -> np.ndarray:
    """How many n-grams of all rows of `text` fall in each bucket: tasks count their own rows, one row a bucket comes back."""
    small_batches(texts.sparkSession)
    found = texts.select("text").mapInArrow(_histogram(buckets, order, most), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found.bucket] = found.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the log of how much likelier it is in the target, both with one more in each bucket."""
    b = len(raw)
    likelier = ((target + 1.0) * float(raw.sum() + b)) / ((raw + 1.0) * float(target.sum() + b))
    return np.floor(1000 * np.log(likelier)).astype(np.int64)


def _weigh(sent: Broadcast, order: int, most: int):
    def weigh(texts: pd.Series) -> pd.DataFrame:
        gain = sent.value
        out = np.zeros((len(texts), 3), np.int64)
        for data, begin, text, carried in _joined(texts, most):
            part, grams, counts = _grams(data, begin, carried, order)
            worth, n = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for crc, counted in zip(grams, counts):
                worth += np.where(counted, gain[crc % np.uint32(len(gain))], 0)
                n += counted
            edge = np.searchsorted(part, np.arange(len(begin) + 1))
            for k, values in enumerate((counts[0], n, worth)):
                total = np.r_[0, np.cumsum(values, dtype=np.int64)]
                np.add.at(out[:, k], text, np.diff(total[edge]))
        release()
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return F.pandas_udf(weigh, "struct<n_words long, n_features long, weight long>")


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = 3, most: int = TOGETHER) -> DataFrame:
    """docs with n_words, n_features and weight added (columns of these names are replaced): how far a text is the target's.

    Features are all runs of up to `order` words, hashed by CRC-32 into buckets. What a bucket gains is told by counts over
    all of docs and all of target (both with `text`); the weight of a text is the sum over its features. Null, empty and
    wordless texts have no features and weight 0. An empty target or an empty docs counts as one feature in every bucket.
    Very long texts are cut for the work, not for the result. Repeated rows count each time. Other columns pass through.

    docs are read twice, once to count and once to weigh, and never shuffled; the gains of all buckets are broadcast.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets, order, most), bucket_counts(target, buckets, order, most))
    docs = docs.drop("n_words", "n_features", "weight")
    held = _unused(docs, "_weighed")
    out = docs.withColumn(held, _weigh(docs.sparkSession.sparkContext.broadcast(gain), order, most)("text"))
    return out.withColumns({c: F.col(f"{held}.{c}") for c in ("n_words", "n_features", "weight")}).drop(held)


def noise(seed: int) -> Column:
    """Gumbel noise of a doc_id in thousandths, from a digest of it and the seed; a null doc_id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed (doc_id, n_words, weight, ...) with score and rank added (columns of these names are replaced).

    Of the N rows with least_words words, the floor(percent*N/100) of highest score are drawn and ranked from 1, ties by
    doc_id ascending, null last; all other rows have no rank. Equal rows are ranked one after the other, each once, so
    ranks are unique; which of two rows that share doc_id and score comes first is not defined. Repeated doc_ids share their
    noise. Any other columns, texts too, go along to the written table.

    Rows are written once as they are and once in the order of the ranking, dealt to tasks by ranges of (drawable, score,
    doc_id, a number of the row), so no score and no doc_id, however frequent, has to fit in one task. A row for each
    range (as many as shuffle partitions), with the number of rows in it, tells where its ranks begin.
    """
    rows = weighed.drop("score", "rank")
    rows = materialize(rows.withColumn("score", F.col("weight") + noise(seed)))
    drawn = (rows.where(F.col("n_words") >= least_words).count() * percent) // 100
    row, at, part = _unused(rows, "_row"), _unused(rows, "_at"), _unused(rows, "_part")
    out = F.col("n_words") < least_words
    order = [out.asc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.col(row).asc()]
    ranged = rows.withColumn(row, F.monotonically_increasing_id()).orderBy(*order)
    # the number of a row says which task it is in, and which row of the task it is
    ranged = materialize(ranged.drop(row).withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)))
    before = F.coalesce(F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = ranged.groupBy(part).count().select(F.col(part).alias("_of"), before.alias("_before"))
    told = ranged.join(F.broadcast(begin), F.col(part) == F.col("_of"))
    nth = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return told.select(*rows.columns, F.when(~out & (nth <= drawn), nth).alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all `documents`, drawn towards `benchmark`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = weigh(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_features", "weight")
    return draw(told).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
with recursive crc(b, k, c) as (select b, 0, b from range(256) t(b) union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
step as (select b, c from crc where k = 8),
word as (select 'd' as side, r, doc_id, w from (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)
  union all select 't', row_number() over (), null,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
gram as (select side, r, array_to_string(w[p : p + m - 1], ' ') as g from (select side, r, w, m, unnest(range(1, len(w) - m + 2)) as p from word, range(1, 4) t(m) where len(w) >= m)),
counted as materialized (select side, r, g, count(*) as n from gram group by all),
hexed as (select g, hex(encode(g)) as h from (select distinct g from counted)),
-- the checksum of a string is the exclusive or of what each of its bytes becomes by the zero bytes behind it, and of the initial ones
size as (select max(len(h)) // 2 as most from hexed),
moved(b, k, c) as (select b, 0, c from step union all
  select moved.b, k + 1, xor(moved.c >> 8, step.c) from moved join step on step.b = moved.c & 255 where k < (select most from size)),
ones(k, c) as (select 0, 4294967295 union all select k + 1, xor(ones.c >> 8, step.c) from ones join step on step.b = ones.c & 255 where k < (select most from size)),
byte as (select g, len(h) // 2 as size, len(h) // 2 - 1 - p as k, (instr('0123456789ABCDEF', h[2 * p + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * p + 2]) - 1 as b
         from (select g, h, unnest(range(len(h) // 2)) as p from hexed)),
bucket as (select g, xor(xor(bit_xor(moved.c), any_value(ones.c)), 4294967295) % 10000 as bucket
           from byte join moved on moved.b = byte.b and moved.k = byte.k join ones on ones.k = byte.size group by g),
total as (select bucket, sum(case when side = 'd' then n else 0 end)::bigint as s, sum(case when side = 't' then n else 0 end)::bigint as t from counted join bucket using (g) group by bucket),
whole as (select coalesce(sum(s), 0)::bigint as s, coalesce(sum(t), 0)::bigint as t from total),
gain as (select bucket, floor(1000 * ln(((total.t + 1)::double * (whole.s + 10000)) / ((total.s + 1)::double * (whole.t + 10000))))::bigint as gain from total, whole),
summed as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join bucket using (g) join gain using (bucket) where side = 'd' group by r),
scored as (select r, doc_id, len(w) >= 20 as fit, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from word left join summed using (r) where side = 'd'),
ranked as (select *, row_number() over (partition by fit order by score desc, doc_id) as nth, count(*) filter (where fit) over () * 5 // 100 as drawn from scored)
select doc_id, n_features, weight, score, case when fit and nth <= drawn then nth end as rank from ranked
"""

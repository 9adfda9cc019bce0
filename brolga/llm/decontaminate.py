"""Benchmark decontamination by Wu-Manber search for every window of the test strings, over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brolga.llm.common import materialize, table, worker_cache

WINDOW = 10
#: The test strings are searched in blocks of about this many words, so that what is broadcast stays small.
BLOCK_WORDS = 500_000
#: words() as a pattern for text whose A-Z are still as they were.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_DELIMITERS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(range(256))
for _c in _DELIMITERS:
    _FOLD[_c] = 0x20
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32
_FOLD = bytes(_FOLD)


def words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; none of a null."""
    return text.encode().translate(_FOLD).split() if text else []


class WuManber:
    """Tables of one pattern length: how far a block of two words lets the search skip, and the patterns that end in a block.

    Inside the bucket of a last block, patterns are kept by their first block; what is left is compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set], length: int):
        self.length = length
        self.single = {p[0]: items for p, items in patterns.items()} if length == 1 else {}
        self.skip: dict[tuple[bytes, bytes], int] = {}
        self.ending: dict[tuple[bytes, bytes], dict[tuple[bytes, bytes], list[tuple[list[bytes], set]]]] = {}
        for pattern, items in patterns.items() if length > 1 else ():
            for i in range(length - 1):
                block = pattern[i : i + 2]
                self.skip[block] = min(self.skip.get(block, length), length - 2 - i)
            self.ending.setdefault(pattern[-2:], {}).setdefault(pattern[:2], []).append((list(pattern), items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, items) of every occurrence."""
        if self.length == 1:
            yield from ((i, self.single[w]) for i, w in enumerate(text) if w in self.single)
            return
        m, n, skip, most = self.length, len(text), self.skip.get, self.length - 1
        last = m - 1
        while last < n:
            block = (text[last - 1], text[last])
            step = skip(block, most)
            if step:
                last += step
                continue
            first = last - m + 1
            for pattern, items in self.ending[block].get((text[first], text[first + 1]), ()):
                if text[first : last + 1] == pattern:
                    yield first, items
            last += 1


def windows_of(item: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    if len(item) <= window:
        return [tuple(item)]
    return [tuple(item[i : i + window]) for i in range(len(item) - window + 1)]


def build(items: list[tuple[int | None, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item_id, text in items:
        for w in windows_of(words(text), window):
            by_length.setdefault(len(w), {}).setdefault(w, set()).add(item_id)
    return [WuManber(p, length) for length, p in sorted(by_length.items())]


def _search(tables: Broadcast, item_kind: str):
    def search(texts: pd.Series) -> pd.DataFrame:
        worker_cache("decontaminate")
        counts, hits, ids = [], [], []
        for text in texts:
            text = words(text)
            covered: set[int] = set()
            of: set = set()
            for t in tables.value:
                for first, which in t.search(text):
                    covered.update(range(first, first + t.length))
                    of |= which
            counts.append(len(text))
            hits.append(sorted(covered))
            ids.append(sorted(of, key=lambda x: (x is not None, x)))
        return pd.DataFrame({"n": counts, "hits": hits, "items": ids})

    return F.pandas_udf(search, f"struct<n long, hits array<int>, items array<{item_kind}>>")


def pieces_of(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text): items cut into pieces of up to `most` windows, each window in one piece; a shorter item is one piece."""
    w = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)), F.lit(most))
    cut = items.select("item_id", w.alias("w")).where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"))
    return cut.select("item_id", F.array_join(F.slice("w", F.col("at"), F.lit(most + window - 1)), " ").alias("text")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with columns hit_words (positions, ascending), hit_items (item ids, ascending) and word_count added.

    A document word is hit if an occurrence of a window covers it: `window` consecutive words of an item, or the whole of
    a shorter item. Null and empty texts have no words and no hits; items without words match nothing; repeated items
    count once by their id, and a null id counts as an id, before all others. item_id may be of any type that can be
    ordered. Other columns of docs pass through; those with the three names above are replaced.

    Test strings, long ones in pieces, are read in blocks of about block_words words, and one block at a time is broadcast.
    If one holds them all, documents are read once and never shuffled. Else each block's hits are written to the shared
    folder, for the documents that have any and by digest of their text, before the next block is broadcast; a
    join brings them back. So what driver and workers hold is one block, however large the benchmark is.
    """
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType.simpleString()
    items = pieces_of(benchmark.select("item_id", "text").where("text is not null"), window, max(1, block_words // 10))
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = 1 + size // (6 * block_words)
    out = docs.drop("hit_words", "hit_items", "word_count")

    def tables(b: int) -> Broadcast:
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], window))

    if blocks == 1:
        found = out.withColumn("_found", _search(tables(0), kind)("text"))
        return found.withColumns({"hit_words": F.col("_found.hits"), "hit_items": F.col("_found.items"), "word_count": F.col("_found.n")}).drop("_found")

    digest, parts = F.sha2("text", 256), []
    for b in range(blocks):
        held = tables(b)
        found = docs.select(digest.alias("_text"), _search(held, kind)("text").alias("found"))
        parts.append(materialize(found.where(F.size("found.hits") > 0).select("_text", "found.hits", "found.items", F.lit(b).alias("block"))))
        held.destroy()
    once = reduce(DataFrame.unionByName, parts).groupBy("_text", "block").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
    union = lambda k: F.sort_array(F.array_distinct(F.flatten(F.collect_list(k))))
    hits = once.groupBy("_text").agg(union("hits").alias("_hits"), union("items").alias("_items"))
    joined = out.withColumn("_text", digest).join(hits, "_text", "left")
    none = F.array().cast(f"array<{kind}>")
    return joined.withColumns(
        {
            "hit_words": F.coalesce("_hits", F.array().cast("array<int>")),
            "hit_items": F.coalesce("_items", none),
            "word_count": F.coalesce(F.regexp_count("text", F.lit(_WORD)).cast("long"), F.lit(0).cast("long")),
        }
    ).drop("_text", "_hits", "_items")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("hit_items", lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    return found.select(
        "doc_id",
        F.col("word_count").alias("n_words"),
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
with doc as (select doc_id, text, row_number() over () as r from documents),
d as (select r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from doc),
i as (select distinct item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
pat as (select distinct item_id, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as s, least(len(w), 10) as m
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
lens as (select distinct m from pat),
dw as (select r, m, p, array_to_string(w[p : p + m - 1], ' ') as s
       from (select r, w, m, unnest(range(1, len(w) - m + 2)) as p from d, lens where len(w) >= m)),
hit as (select dw.r, dw.p, dw.m, pat.item_id from dw join pat on dw.s = pat.s and dw.m = pat.m),
cov as (select r, count(*) as n_hit from (select distinct r, unnest(range(p, p + m)) as q from hit) group by r),
its as (select r, count(*) as n_items, string_agg(x, ',' order by x) as names from (select distinct r, cast(item_id as varchar) as x from hit) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov on cov.r = d.r left join its on its.r = d.r
"""

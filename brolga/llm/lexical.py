"""Ranked lexical search: every document for a set of items, by accumulators of short lists beside iterators over long ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brolga.llm.common import small_batches, table, worker_cache
from brolga.llm.flat import blocks, flat, fold_table, words_of

TOP = 10
#: Items are searched in passes of about so many terms, so that what is broadcast stays small.
BLOCK_TERMS = 200_000
#: A list is short if it holds at most one of so many documents of a block.
SHORT = 16

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = fold_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Items:
    """A pass: terms in byte order, the numbers of each item's terms, item ids; weight of each term as soon as it is known."""

    terms: list[bytes]
    of: list[np.ndarray]
    ids: list
    weight: np.ndarray | None = None
    documents: int = 0
    words: int = 0


class Index:
    """Inverted lists of one block of documents, for the terms of the items only."""

    def __init__(self, texts: pa.Array, terms: pa.Array):
        data, bounds = flat(texts)
        words, doc = words_of(_FOLD[data], bounds)
        self.size = len(texts)
        self.words = np.bincount(doc, minlength=self.size)
        code = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy().astype(np.int64)
        known = code >= 0
        key, self.tf = np.unique(code[known] * self.size + doc[known], return_counts=True)
        term, self.doc = np.divmod(key, self.size)
        self.bounds = np.searchsorted(term, np.arange(len(terms) + 1))
        self.lengths = np.diff(self.bounds)
        self.term = term

    def weigh(self, items: Items) -> None:
        """What each entry adds to the score of its document, and the most that a list can add."""
        m = 10 + (90 * self.words.astype(np.int64) * items.documents) // max(items.words, 1)
        self.adds = items.weight[self.term] * ((1_000_000_000 * self.tf) // (1000 * self.tf + 8 * m[self.doc]))
        self.most = np.zeros(len(self.lengths), np.int64)
        some = np.flatnonzero(self.lengths)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.adds, self.bounds[some])

    def search(self, terms: np.ndarray, k: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best that score `need` or more, highest first, then in the order of documents."""
        terms = terms[self.lengths[terms] > 0]
        none = np.zeros(0, np.int64)
        if self.most[terms].sum() < need:
            return none, none
        one = lambda t: slice(self.bounds[t], self.bounds[t + 1])
        short = self.lengths[terms] * SHORT <= self.size
        sums = np.zeros(self.size, np.int64)
        for t in terms[short]:
            sums[self.doc[one(t)]] += self.adds[one(t)]
        summed = np.flatnonzero(sums)
        lists = [(int(self.most[t]), self.doc[one(t)], self.adds[one(t)]) for t in terms[~short]]
        if len(summed):
            lists.append((int(sums[summed].max()), summed, sums[summed]))
        lists.sort(key=lambda x: x[0])
        reach = np.cumsum([x[0] for x in lists])
        # lists before this one cannot reach `need` together: they are only looked into for documents of the others
        first = int(np.searchsorted(reach, need))
        score = np.zeros(self.size, np.int64)
        for _, docs, adds in lists[first:]:
            score[docs] += adds
        found = np.flatnonzero(score)
        for at in range(first - 1, -1, -1):
            found = found[score[found] + reach[at] >= need]
            if not len(found):
                return none, none
            _, docs, adds = lists[at]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score[found] += np.where(docs[place] == found, adds[place], 0)
        found = found[score[found] >= need]
        best = found[np.argsort(-score[found], kind="stable")[:k]]
        return best, score[best]


def _count(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, docs, words = pa.array(sent.value.terms, pa.large_binary()), np.zeros(len(sent.value.terms), np.int64), 0, 0
        worker_cache("lexical")
        for block in blocks(batches, "text"):
            index = Index(block.column("text").combine_chunks(), terms)
            held += index.lengths
            docs += int((index.words > 0).sum())
            words += int(index.words.sum())
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[docs, words, held[some]])], names=["term", "n"])

    return run


def _rank(sent: Broadcast, k: int, columns: list[str], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        terms, best, types = pa.array(items.terms, pa.large_binary()), [[] for _ in items.ids], None
        worker_cache("lexical")
        order = lambda x: (-x[0], x[1][0] is None, x[1][0])
        for block in blocks(batches, "text"):
            block = block.take(pc.sort_indices(block, [(columns[0], "ascending")], null_placement="at_end"))
            types = [block.schema.field(c).type for c in columns]
            index = Index(block.column("text").combine_chunks(), terms)
            index.weigh(items)
            for i, own in enumerate(items.of):
                need = best[i][-1][0] if len(best[i]) == k else 1
                found, scores = index.search(own, k, need)
                if len(found):
                    rows = block.select(columns).take(found)
                    new = zip(scores.tolist(), zip(*[rows.column(j).to_pylist() for j in range(len(columns))]))
                    best[i] = sorted([*best[i], *new], key=order)[:k]
        if types:
            rows = [(items.ids[i], score, values) for i, own in enumerate(best) for score, values in own]
            held = [pa.array([r[0] for r in rows], item_type), pa.array([r[1] for r in rows], pa.int64())]
            held += [pa.array([r[2][j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.record_batch(held, names=["item_id", "score", *columns])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the different terms of each item; rows that share an item_id are one item, also those without one."""
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_WORD), F.lit(0)))
    rows = items.select("item_id", words.alias("w")).where(F.size("w") > 0)
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("terms"))


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP, columns: tuple[str, ...] = ("doc_id",), block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, rank, *columns, score): the k documents of highest score for each item of (item_id, text), best first.

    Terms, weights and scores are whole numbers as in `Index.weigh`; a document without any term of an item, or of score 0,
    is not listed, so an item without words has no row. Equal scores go by the first of `columns`, ascending, null last.
    A null text has no terms; repeated rows are documents of their own, each with a rank. Other columns of docs are not
    looked at; `columns` names those that come back with each hit, texts too. Empty tables give no rows.

    Every task builds inverted lists for one block of its documents after the other, and lets every item search them. What
    short lists add is summed first; the sums are one more iterator, with the largest sum as its bound, beside those over
    long lists. Lists that cannot lift a document into the k best so far, all together, are only looked into for documents
    that another list names; a block whose lists cannot do so is skipped. A task hands on k rows for each item, so the last
    ranking sees k rows for each task and item. Items are broadcast in passes of about block_terms terms, each with a count of
    its terms before; the terms of one item are never parted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = item_terms(items)
    total = wanted.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    passes = 1 + total // block_terms
    texts = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    kind = items.schema["item_id"].dataType
    out = []
    for b in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == b).collect()
        terms = sorted({t.encode() for r in rows for t in r.terms})
        code = {t: n for n, t in enumerate(terms)}
        own = Items(terms, [np.array([code[t.encode()] for t in r.terms], np.int64) for r in rows], [r.item_id for r in rows])
        first = spark.sparkContext.broadcast(own)
        counts = docs.select("text").mapInArrow(_count(first), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        first.destroy()
        n = counts.set_index("term").n
        own.documents, own.words = int(n.get(-2, 0)), int(n.get(-1, 0))
        held = n.reindex(range(len(terms)), fill_value=0).to_numpy(np.float64)
        own.weight = np.floor(1000 * np.log((2 * own.documents + 2) / (2 * held + 1))).astype(np.int64)
        sent = spark.sparkContext.broadcast(own)
        out.append(texts.mapInArrow(_rank(sent, k, list(columns), to_arrow_type(kind)), f"item_id {kind.simpleString()}, score long, {schema}"))
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last(columns[0]))
    ranked = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", *columns, "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's four columns of `rank_documents` for every item of `benchmark` over all `documents`."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with word as (select r, doc_id, unnest(w) as t from (select doc_id, row_number() over () as r,
       regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents)),
entry as (select r, doc_id, t, count(*) as tf from word group by all),
doc as (select r, doc_id, sum(tf)::bigint as n from entry group by all),
whole as (select count(*) as docs, sum(n)::bigint as words from doc),
item as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
term as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from entry, whole where t in (select t from item) group by t, docs),
m as (select r, 10 + (90 * n * docs) // words as m from doc, whole),
score as (select item_id, r, entry.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
          from item join entry using (t) join term using (t) join m using (r) group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from score where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

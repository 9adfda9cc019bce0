import math
import random
import re

import numpy as np
import pyarrow as pa

from brolga.llm import flat, lexical
from brolga.llm.lexical import rank_documents

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    told = [(d, words(t)) for d, t in docs]
    n_docs, total = sum(1 for _, w in told if w), sum(len(w) for _, w in told)
    df = {}
    for _, w in told:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, w in told:
            m = 10 + (90 * len(w) * n_docs) // total
            s = sum(weight[t] * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, d is None, d, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, x[2], x[3]) for r, x in enumerate(scored[:k])]
    return sorted(out, key=str)


def data():
    rnd = random.Random(5)
    vocabulary = [f"w{j}" for j in range(40)] + ["Éİx", "zß", "\U0001d400q", "İ"]
    say = lambda n: " ".join(rnd.choice(vocabulary[: rnd.randint(2, 44)]) + rnd.choice(["", ".", "-", "\n"]) for _ in range(n))
    docs = [(j, say(rnd.randint(0, 40))) for j in range(300)]
    docs += [(None, say(10)), (None, None), (400, None), (401, ""), (402, " .,"), (403, say(9000))]
    docs += [(500 + j, docs[3][1]) for j in range(60)] + [docs[4]] * 15 + [(3, "W1 w2"), (700, docs[0][1].upper())]
    items = [(j, say(rnd.randint(1, 15))) for j in range(12)] + [(12, None), (13, ""), (14, "nowhere"), (None, "w3 w4"), (2, "w5 W6"), (0, docs[3][1])]
    items += items[:2]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int")
    d = spark.createDataFrame([(*x, {"a": 1}) for x in docs], "doc_id long, text string, score map<string, int>")
    want = brute(docs, items)
    get = lambda **o: sorted(map(tuple, rank_documents(d, b, **o).collect()), key=str)
    assert get() == want
    assert get(block_terms=20) == want
    assert get(k=3) == brute(docs, items, 3) and get(k=1000) == brute(docs, items, 1000)
    few = d.where("doc_id < 3")
    assert sorted(map(tuple, rank_documents(few, b).collect()), key=str) == brute([x for x in docs if x[0] is not None and x[0] < 3], items)
    assert rank_documents(d.limit(0), b).count() == 0 and rank_documents(d, b.limit(0)).count() == 0
    with_text = rank_documents(d, b, k=1, columns=("doc_id", "text")).collect()
    assert all(r.text in [t for i, t in docs if i == r.doc_id] for r in with_text)


def test_blocks_keep_rows_and_order():
    rnd = random.Random(2)
    texts = [None if rnd.random() < 0.1 else "é" * rnd.randint(0, 30) for _ in range(200)] + ["x" * 5000, None, "", "y"]
    batches = [pa.record_batch([pa.array(texts[k : k + 7], pa.string()), pa.array(range(k, min(k + 7, len(texts))))], names=["text", "n"]) for k in range(0, len(texts), 7)]
    for most in (1, 50, 10**6):
        got = list(flat.blocks(iter(batches), "text", most))
        assert [n for t in got for n in t.column("n").to_pylist()] == list(range(len(texts)))
        assert all(t.num_rows for t in got) and all(t.num_rows == 1 or sum(len((x or "").encode()) for x in t.column("text").to_pylist()) <= most for t in got)
    assert list(flat.blocks(iter([]), "text")) == []


def test_words_end_with_their_text():
    data, bounds = flat.flat(pa.array(["ab c", None, "d", "", " e  f", "g"]).slice(0))
    got, doc = flat.words_of(data, bounds)
    assert list(zip(got.to_pylist(), doc.tolist())) == [(b"ab", 0), (b"c", 0), (b"d", 2), (b"e", 4), (b"f", 4), (b"g", 5)]


def test_lists_that_cannot_lift_are_only_looked_into():
    """Whatever is asked for, the pruned search finds what summing every list finds."""
    rnd = np.random.default_rng(4)
    vocabulary = [f"t{j}".encode() for j in range(30)]
    chance = 1 / np.arange(1, 31)
    texts = [" ".join(vocabulary[j].decode() for j in rnd.choice(30, rnd.integers(1, 25), p=chance / chance.sum())) for _ in range(500)]
    index = lexical.Index(pa.array(texts), pa.array(vocabulary, pa.large_binary()))
    index.weigh(lexical.Items(vocabulary, [], [], np.floor(1000 * np.log(1002 / (2 * index.lengths + 1))).astype(np.int64), 500, int(index.words.sum())))
    for _ in range(200):
        terms = np.sort(rnd.choice(30, rnd.integers(1, 12), replace=False))
        whole = np.zeros(500, np.int64)
        for t in terms:
            at = slice(index.bounds[t], index.bounds[t + 1])
            whole[index.doc[at]] += index.adds[at]
        need = int(rnd.choice([1, *np.quantile(whole, [0.5, 0.9, 0.99, 1.0]).astype(int), whole.max() + 1]))
        best = [d for d in np.argsort(-whole, kind="stable")[:10] if whole[d] >= max(need, 1)]
        got, scores = index.search(terms, 10, max(need, 1))
        assert got.tolist() == best and scores.tolist() == whole[best].tolist()

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brolga.llm import bloomlm
from brolga.llm.bloomlm import CELLS, END, LEVELS, Answers, Filter, Model, fit, least_of, level, most_of, op4_bloomlm, pairs, score, segment, single, tokens, trusts


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute_base(rows, train):
    c = Counter(t for text in train for t in split(text))
    n, v = sum(c.values()), len(c)
    out = []
    for text in rows:
        own = split(text)
        out.append((len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own)))
    return out


def test_filter_keeps_levels():
    rnd = np.random.default_rng(10)
    ids = np.unique(rnd.integers(0, 1 << 48, 20000).astype(np.uint64))
    n = rnd.zipf(1.5, len(ids)).clip(1, 10**6)
    data = segment(ids, n, 1, 12)
    f = Filter(1, 48, np.zeros(1, np.uint64), np.array([8 * len(data)], np.uint64), data)
    got = f.levels(ids)
    assert (got >= level(n, 1)).all() and (got == level(n, 1)).mean() > 0.98
    assert (f.levels(rnd.integers(0, 1 << 48, 20000).astype(np.uint64)) == 0).mean() > 0.98
    exact = np.arange(1, 5000)
    low, high = least_of(level(exact, 1), 1), most_of(level(exact, 1), 1)
    assert (low <= exact).all() and (exact <= high).all() and (high <= 1.25 * low).all() and level(np.array([0, 1, 2, 3]), 2).tolist() == [0, 1, 2, 3]
    low, high = least_of(level(exact, 2), 2), most_of(level(exact, 2), 2)
    assert (low <= exact).all() and (exact <= high).all() and high[0] == low[0] == 1


def test_a_full_filter_raises():
    full = Filter(2, 48, np.zeros(1, np.uint64), np.array([512], np.uint64), np.full(64, 255, np.uint8))
    with pytest.raises(ValueError, match="full"):
        full.levels(np.array([5, 6], np.uint64))


def test_what_follows_a_word_adds_up_to_one_at_most():
    rnd = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.4, 300).clip(1, 400)) for _ in range(40)]
    names, first = tokens(texts)
    kinds = np.unique(names)

    def exact(ids, least):
        ids, n = np.unique(ids, return_counts=True)
        return ids, level(n, least)

    ids1, lev1 = exact(single(names), 1)
    ids2, lev2 = exact(pairs(names, first), 2)

    class Whole(Answers):
        def levels(self, ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            return np.where(self.ids[at] == ids, self.found[at], 0)

        levels_again = levels

    for trust in (0.0, 0.5, 0.999):
        model = Model(len(names), len(kinds), Whole(1, ids1, lev1), Whole(2, ids2, lev2), np.full(LEVELS, trust))
        after = [*kinds.tolist(), 77]
        for before in kinds[:: len(kinds) // 40].tolist():
            said = np.array([x for w in after for x in (before, w)], np.uint64)
            p = 10.0 ** model.log10(said, np.arange(0, len(said), 2))[1::2]
            assert 0 < p.min() and p.sum() <= 1 + 1e-9


def test_score_follows_its_formula(spark):
    texts = ["a b a b c", "a b d", "b a", None, "x " * 300]
    d = spark.createDataFrame([(k, t, False) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    model, counts = fit(d)
    own = [split(t) for t in texts]
    c, two = Counter(t for o in own for t in o), Counter(p for o in own for p in zip([None, *o[:-1]], o))
    q = lambda n, least, of=least_of: float(of(level(np.array([n]), least), least)[0])
    n, v = sum(c.values()), len(c)
    for head in (0, 10**6):
        for r in score(d, model, counts, head).collect():
            o = own[r.doc_id]
            want = 0.0
            for h, w in zip([None, *o[:-1]], o):
                alone = (q(c[w], 1) + 1) / (n + v + 1)
                t = model.trust[level(np.array([c[h]]), 1)[0]]
                before = q(c[h], 1, most_of)
                want += math.log10(t * min(q(two[h, w], 2), before) / before + (1 - t) * alone)
            assert abs(r.score - want) < 1e-6 * max(1, abs(want))
            assert abs(r.base_score - brute_base([texts[r.doc_id]], texts)[0][3]) < 1e-6


def test_trust_is_likeliest():
    n = np.zeros((LEVELS, CELLS))
    n[3, [0, 70, 80]] = 500, 300, 200
    ratio = 2.0 ** ((np.array([70, 80]) - CELLS // 2 + 0.5) / 2)
    best = max(np.arange(1, 999) / 1000, key=lambda t: 500 * np.log(1 - t) + (n[3, [70, 80]] * np.log(t * ratio + 1 - t)).sum())
    assert abs(trusts(n, 500)[3] - best) < 0.002 and trusts(n)[4] == 0


def test_odd_rows(spark):
    texts = [None, "", "A ä\x1cb\x85 A", "w " * 100000, "never seen", "A ä\x1cb\x85 A"]
    d = spark.createDataFrame([(None if k == 2 else k % 4, t, k == 4, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean, score int, row int")
    model, counts = fit(d.where("not held_out"))
    want = brute_base(texts, [t for k, t in enumerate(texts) if k != 4])
    for head in (0, 2, 10**6):
        got = score(d.repartition(3), model, counts, head).collect()
        key = lambda x: (x[0], x[1], round(x[3], 6))
        assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted((*w[:3], round(w[3], 4)) for w in want)
    small, _ = fit(d, most_bytes=64)
    assert len(small.words.data) + len(small.pairs.data) < 64 * 8
    model, counts = fit(d.limit(0))
    assert score(d, model, counts).count() == 6 and score(d.limit(0), model, counts).count() == 0
    assert tokens([None])[0].tolist() == [END] and len(pairs(*tokens(["a b"]))) == 3


def test_names():
    texts = ["A b", None, "", " b\x0bÄ a\x1c x", "a" * 3000 + " a"]
    names, first = tokens(texts)
    own = [split(t) for t in texts]
    flat = [t for o in own for t in o]
    assert len(names) == len(flat) and first.tolist() == [sum(map(len, own[:k])) for k in range(len(own))]
    known = {}
    assert all(known.setdefault(t, n) == n for t, n in zip(flat, names.tolist())) and len(set(known.values())) == len(known) and known[None] == END
    assert tokens([])[0].tolist() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    want = dict(zip([r.doc_id for r in docs], brute_base([r.text for r in docs], [r.text for r in docs if not out[r.doc_id]])))
    rows = op4_bloomlm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], *w[:3]) and abs(r.base_score - w[3]) < 1e-6 * abs(w[3])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filters_too_large_to_broadcast_score_the_same(spark, monkeypatch):
    rnd = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.3, 400).clip(1, 3000)) for _ in range(60)] + [None, "", "x y " * 3000]
    d = spark.createDataFrame([(k, t, k % 5 == 0) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(3)
    got = []
    for most, share in ((1 << 28, 1), (64, 1 << 22), (64, 3000)):
        monkeypatch.setattr(bloomlm, "SHARE", share)
        model, counts = fit(d.where("not held_out"), most_bytes=most, bucket=1000)
        assert (model.shelf is None) == (most > 64)
        got.append((model.trust.tolist(), sorted(map(tuple, score(d, model, counts).collect()))))
    assert len(got[0][1]) == len(texts) and got[0] == got[1] == got[2]


def test_hot_pair_is_sent_once_from_a_block():
    texts = pa.record_batch({"text": ["a b", "x " * 100000, "a b"]})
    rows = [r for b in bloomlm._neighbours(42, 64)(iter([texts])) for r in b.to_pylist()]
    ids = np.concatenate([bloomlm._unpack(r["ids"]) for r in rows])
    n = np.concatenate([np.frombuffer(r["n"], "<u4") for r in rows])
    want = Counter(p for t in ("a b", "x " * 100000, "a b") for p in pairs(*tokens([t])).tolist())
    assert len(ids) == len(want) == 6 and dict(zip(ids.tolist(), n.tolist())) == want and all(i >> 42 == r["bucket"] for r in rows for i in bloomlm._unpack(r["ids"]).tolist())


def test_pairs_seen_once_and_ids_of_any_type(spark):
    texts = ["a b", "c d", "e f g", "a c e"]
    d = spark.createDataFrame([(f"id{k}", t, False) for k, t in enumerate(texts)], "doc_id string, text string, held_out boolean")
    model, counts = fit(d)
    assert model.pairs.levels(pairs(*tokens(texts))).min() >= 1
    for most in (1 << 28, 64):
        model, counts = fit(d, most_bytes=most, bucket=1)
        got = score(d.selectExpr("struct(doc_id as x) as doc_id", "text", "held_out"), model, counts).collect()
        assert sorted(r.doc_id.x for r in got) == ["id0", "id1", "id2", "id3"] and {r.doc_id for r in score(d, model, counts).collect()} == {f"id{k}" for k in range(4)}

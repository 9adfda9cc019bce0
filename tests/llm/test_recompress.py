import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from brolga.llm import recompress
from brolga.llm.recompress import Block, dedup_substrings, level_for


def brute(texts, window):
    own = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def one_block(*texts, window=35):
    return Block(pa.array(texts, pa.string()), window)


def test_equal_windows_have_the_same_symbols_inside():
    rnd = random.Random(6)
    assert [level_for(w) for w in (1, 3, 4, 15, 16, 31, 35, 64)] == [0, 0, 1, 2, 3, 3, 4, 5]
    for window in (1, 4, 15, 16, 31, 35, 63):
        for letters in (1, 2, 3, 50):
            inner = [f"w{rnd.randrange(letters)}" for _ in range(window)]
            found, some = set(), 0
            for _ in range(60):
                around = [[f"w{rnd.randrange(letters)}" for _ in range(rnd.choice([0, 1, rnd.randrange(40)]))] for _ in range(2)]
                block = one_block("w0 w1 " * 5, " ".join(around[0] + inner + around[1]), None, "w0 " * 40, window=window)
                p, seen = 10 + len(around[0]), []
                for level in range(level_for(window) + 1):
                    own = block.symbols
                    own.rise(level)
                    low, high = own.windows()
                    inside = (low <= p) & (p < high)
                    assert (own.low[inside] >= p).all() and (own.high[inside] <= p + window).all()
                    assert (own.low <= own.start).all() and (own.stop <= own.high).all() and (own.stop[:-1] == own.start[1:]).all()
                    seen.append(tuple(zip((own.start[inside] - p).tolist(), (own.stop[inside] - p).tolist(), own.names[inside].tolist())))
                found.add(tuple(seen))
                some += len(seen[min(1, level_for(window))])
            assert len(found) == 1 and (some or window < 6 or letters < 3)


def test_runs_and_pairs_are_named_by_what_they_are():
    texts = ["a a b c c c d " * 3, "x a a b", "c c c"]
    one = one_block(*texts, window=9)
    one.symbols.fold_runs()
    flat = [w for t in texts for w in t.split()]
    spell = lambda: [tuple(flat[i:j]) for i, j in zip(one.symbols.start.tolist(), one.symbols.stop.tolist())]
    assert spell()[:5] == [("a", "a"), ("b",), ("c",) * 3, ("d",), ("a", "a")] and spell()[-1] == ("c",) * 3
    for _ in range(3):
        one.symbols.join_pairs()
        of = {}
        for name, words in zip(one.symbols.names.tolist(), spell()):
            of.setdefault(name, set()).add(words)
        assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(of)
        assert all(one.doc[i] == one.doc[j - 1] for i, j in zip(one.symbols.start, one.symbols.stop))


def test_words_and_digests_are_those_of_their_text():
    texts = ["a b\x0bc \x1c", None, "", "ä\u2003x  a", "long" * 3000 + " b", "a b c d e a b c d"]
    one = one_block(*texts, window=3)
    own = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert one.sizes.tolist() == [len(w) for w in own]
    known = {}
    flat = [w for o in own for w in o]
    assert all(known.setdefault(w, n) == n for w, n in zip(flat, one.words.tolist())) and len(set(known.values())) == len(known)
    found, many = one.digests()
    windows = Counter(tuple(w[i : i + 3]) for w in own for i in range(len(w) - 2))
    assert len(found) == len(windows) and sorted(many.tolist()) == sorted(n > 1 for n in windows.values())


def texts(rnd, n):
    pool = [[f"p{k}w{i}" for i in range(rnd.randint(20, 80))] for k in range(6)] + [["the"] * 60, ["a", "b"] * 40, ["x", "y", "z"] * 30]
    out = []
    for k in range(n):
        w = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(pool)
            i = rnd.randint(0, 10)
            w += p[i : len(p) - rnd.randint(0, 10)] + [f"d{k}u{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 30))]
        out.append(rnd.choice([" ", "\n", " \t"]).join(w))
    return out + [None, "", " ", "\x1c é\x85ü\xa0v " * 40, "long " * 9000, out[3], out[3]]


def test_against_brute_force(spark):
    rnd = random.Random(7)
    rows = list(enumerate(texts(rnd, 120)))
    rows[5] = (None, rows[5][1])
    rows.append(rows[7])
    d = spark.createDataFrame([(*r, "k", 2.0) for r in rows], "doc_id long, text string, `a key` string, n_words double").repartition(4)
    for window in (35, 6, 1):
        want = Counter(brute([t for _, t in rows], window))
        for letters in (1 << 22, 2000):
            got = dedup_substrings(d, window, letters).collect()
            assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
            assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
            assert all(r["a key"] == "k" for r in got)
    assert dedup_substrings(d.limit(0)).count() == 0
    assert dedup_substrings(d.where("length(text) < 5"), with_text=False).columns == ["doc_id", "text", "a key", "n_words", "n_removed", "kept_sha256"]


def test_a_phrase_that_all_documents_share_asks_little(spark):
    """A stock phrase shorter than a window makes no live window, and a passage of all documents is asked for once a block."""
    rnd = random.Random(14)
    phrase, passage = "this short notice stands in every single text".split(), [f"p{k}" for k in range(40)]
    own = [[f"a{rnd.randrange(10**9)}" for _ in range(40)] + phrase + [f"b{rnd.randrange(10**9)}" for _ in range(40)] for _ in range(300)]
    block = one_block(*[" ".join(w) for w in own])
    names, many = block.names(level_for(35))
    block.drop(many)
    assert not block.live.any()
    block = one_block(*[" ".join(w + passage) for w in own])
    names, many = block.names(level_for(35))
    block.drop(many)
    names, many = block.digests()
    assert many.sum() == 6 and len(names) < 24 * 300
    rows = [(k, " ".join(w)) for k, w in enumerate(own)] + [(1000 + k, " ".join(own[k])) for k in range(3)]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), letters=3000).collect()
    assert {r.doc_id for r in got if r.n_removed} == {0, 1, 2, 1000, 1001, 1002} and all(r.n_removed in (0, 88) for r in got)


def test_blocks_of_several_parts_and_many_buckets(spark, monkeypatch):
    """However large blocks, parts and buckets are, the same words go."""
    rnd = random.Random(9)
    rows = list(enumerate(texts(rnd, 80)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(brute([t for _, t in rows], 35))
    for letters, most, meet in ((500, 1 << 30, 3000), (500, 4000, 100), (1 << 21, 1 << 25, 50)):
        monkeypatch.setattr(recompress, "LETTERS", letters)
        monkeypatch.setattr(recompress, "PART", 1)
        monkeypatch.setattr(recompress, "MOST", most)
        monkeypatch.setattr(recompress, "MEET", meet)
        monkeypatch.setattr(recompress, "MEETS", meet)
        got = dedup_substrings(d, with_text=False).collect()
        assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_rows_that_travel_for_a_name_stay_as_many():
    """A block's rows for its names at 1, 30 and 1000 GB: blocks grow with the corpus, so that a row keeps holding many."""
    rnd = np.random.default_rng(2)
    for gb in (1, 30, 1000):
        total = gb << 30
        letters, meet = max(recompress.LETTERS, min(recompress.MOST, total // recompress.PART)), max(recompress.MEET, min(recompress.MEETS, total // 64))
        names = np.unique(rnd.integers(0, 1 << 48, letters // 32).astype(np.uint64))
        rows = recompress._asks(0, [(names, np.zeros(len(names), bool))], 1 + total // meet)
        assert rows.num_rows < len(names) / 100 and rows.nbytes < 6.6 * len(names)

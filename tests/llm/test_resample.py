import hashlib
import math
import random
import re
import zlib

import numpy as np

from brolga.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[j : j + n]) for n in (1, 2, 3) for j in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for into, texts in ((s, [x[1] for x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for doc_id, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = fit[: percent * len(fit) // 100]
    left = {}
    for k, r in enumerate(drawn):
        left.setdefault(r, []).append(k + 1)
    return sorted((*r[:4], left[r].pop(0) if left.get(r) else None) for r in sorted(rows, key=str)) if all(r[0] is not None for r in rows) else (rows, drawn)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(["ab", "Cd", "é9", "İx", "ABC-def", "q" * 40, "1", "\U0001d400"]) for _ in range(n))
    docs = [(j, say(rnd.randint(0, 60))) for j in range(150)] + [(200, None), (201, ""), (202, " ., "), (203, say(4000)), (204, "x" * 9000 + " y z")]
    docs += [(300 + j, docs[7][1]) for j in range(40)]
    target = [say(15) for _ in range(9)] + [None, "", "ab cd"]
    b = spark.createDataFrame([(x, 1) for x in target], "text string, weight int")
    d = spark.createDataFrame([(*x, {"k": 1}, 5) for x in docs], "doc_id long, text string, _weighed map<string, int>, rank int").repartition(5)
    want = brute(docs, target, percent=30)
    for most in (64, 1 << 20):
        told = resample.weigh(d, b, most=most)
        assert told.columns == ["doc_id", "text", "_weighed", "rank", "n_words", "n_features", "weight"]
        got = resample.draw(told, percent=30)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want
        assert {r.text for r in got.collect()} == {x[1] for x in docs}


def test_repeated_rows_and_nulls_have_ranks_of_their_own(spark):
    text = " ".join(f"w{j}" for j in range(25))
    docs = [(1, text)] * 50 + [(None, text)] * 30 + [(j, text + " more") for j in range(2, 22)] + [(None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = resample.draw(resample.weigh(d, d.limit(1)), percent=60).collect()
    _, drawn = brute(docs, [text], 60)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r.score) for r in ranked] == [r[3] for r in drawn] and len(got) == len(docs)
    assert [r.doc_id for r in ranked] == [r[0] for r in drawn]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id string, text string")
    assert resample.draw(resample.weigh(d.limit(0), d)).count() == 0
    row = resample.draw(resample.weigh(d, d.limit(0)), percent=100, least_words=1).first()
    assert (row.n_features, row["rank"]) == (6, 1)
    assert resample.draw(resample.weigh(d, d), percent=50).first()["rank"] is None


def test_checksums_of_joined_strings():
    rnd = random.Random(1)
    for n in (0, 1, 2, 7, 64, 1000, 70000):
        a, b = rnd.randbytes(rnd.randint(0, 50)), rnd.randbytes(n)
        got = resample._followed(np.array([zlib.crc32(a)], np.uint32), np.array([n]), np.array([zlib.crc32(b)], np.uint32))
        assert got[0] == zlib.crc32(a + b)

import math
import re
import zlib

import numpy as np
import pyarrow as pa

from brolga.llm import quality
from brolga.llm.quality import fit, judge, op12_quality

SF = "/root/testdata/sf0.01"


def form(word):
    out = []
    for b in word.encode():
        c = chr(b)
        c = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or b > 127 else "0" if "0" <= c <= "9" else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out).encode()


def terms(text):
    words, out = re.findall("[^\x00-\x20]+", text or ""), {}
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w).encode() for w in words]
    rest = quality.TERMS - quality.WORDS
    for k, w in enumerate(words):
        again = b"again " if k and low[k] == low[k - 1] else b""
        for t in (zlib.crc32(low[k]) % quality.WORDS, quality.WORDS + zlib.crc32(again + form(w)) % rest):
            out[t] = out.get(t, 0) + 1
    return out


TEXTS = ["Ab ab ÉÈ x1!! x1!!", None, "", "THE!! END!!", " \n", "a\tb  c***", "Z", "ab", "é" * 20 + " é", "x " * 500]


def test_terms_and_votes_against_plain_code():
    text, term, n = quality.terms_of(pa.array(TEXTS))
    got = [{} for _ in TEXTS]
    for a, b, c in zip(text.tolist(), term.tolist(), n.tolist()):
        got[a][b] = c
    assert got == [terms(t) for t in TEXTS]

    rnd = np.random.default_rng(1)
    idf, axes = rnd.uniform(1, 3, quality.TERMS), rnd.standard_normal((quality.TERMS, 5)).astype(np.float32)
    vectors = rnd.standard_normal((60, 5)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rnd.integers(0, 2, 60).astype(float)
    votes = quality.Votes(idf, axes, vectors, labels, 0.4)
    want = []
    for t in TEXTS * 60:
        parts = [{k: (1 + math.log(c)) * idf[k] for k, c in terms(t).items() if (k < quality.WORDS) == low} for low in (True, False)]
        own = sum(v / math.sqrt(sum(x * x for x in p.values())) * axes[k].astype(float) for p in parts for k, v in p.items())
        if not parts[0]:
            want.append(0.4)
            continue
        cosine = vectors @ (own / np.linalg.norm(own))
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** quality.SHARP
        want.append((weight * labels[near]).sum() / weight.sum())
    assert np.allclose(votes.scores(pa.array(TEXTS * 60)), want, atol=1e-4)


def auc(scores, labels):
    up, down = scores[labels == 1], scores[labels == 0]
    return np.mean([(s > down).mean() + (s == down).mean() / 2 for s in up])


def test_held_out_accuracy(spark):
    got = op12_quality(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    frame = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(frame) == spark.read.parquet(f"{SF}/documents.parquet").count() and frame.score.between(0, 1).all()
    held = frame[frame.held_out & frame.quality.notna()]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all() and len(held) > 50
    assert (held.predicted == held.quality).mean() >= 0.95 and auc(held.score.to_numpy(), held.quality.to_numpy()) >= 0.97


def test_held_out_labels_and_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as label")
    one = fit(docs.where(~quality.held_out()), labels, 200, 8)
    other = fit(docs.where(~quality.held_out()).selectExpr("doc_id", "text", "map('a', lang) as score"), labels.union(labels), 200, 8)
    assert np.array_equal(one.vectors, other.vectors) and np.array_equal(one.labels, other.labels)
    odd = docs.selectExpr("doc_id", "text", "map('a', lang) as h", "source as predicted", "lang as label")
    got = judge(odd, one)
    assert got.columns == ["doc_id", "text", "h", "label", "score", "predicted"] and got.count() == docs.count()


def test_nulls_copies_ties_and_empty_tables(spark):
    good, bad = "Some plain words of a text.", "SHOUT!! SHOUT!! NOW!!"
    docs = spark.createDataFrame(
        [(k, good + f" n{k}") for k in range(12)] + [(20 + k, bad + f" N{k}!!") for k in range(12)] + [(None, good), (60, None), (61, ""), (62, " \n"), (63, bad * 400)] + [(70, bad)] * 40,
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(k, 1) for k in range(12)] + [(20 + k, 0) for k in range(12)] + [(60, 0), (61, 1), (None, 0), (70, 0), (70, 0), (71, None)], "doc_id long, label int")
    votes = fit(docs, labels)
    assert len(votes.labels) == 12 + 12 + 1 + 1
    told = {}
    for r in judge(docs, votes).collect():
        told.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert all(len(v) == 1 for v in told.values()) and all(s > 0.7 and p == 1 for s, p in told[3] | told[None])
    assert all(s < 0.3 and p == 0 for s, p in told[25] | told[70] | told[63])
    assert told[60] == told[61] == told[62] == {(votes.prior, int(votes.prior >= 0.7))}
    assert judge(docs.limit(0), votes).count() == 0
    none = fit(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in judge(docs, none).collect()} == {(0.5, 0)}
    few = fit(docs, labels, rows=5)
    assert len(few.labels) == 5 and judge(docs, few).count() == docs.count()

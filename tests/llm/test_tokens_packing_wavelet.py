import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brolga.llm.common import shared_dir
from brolga.llm.packing import op7_pack, pack, step_groups
from brolga.llm.tokens import encoder
from brolga.llm.wavelet import WaveletMatrix, access, count, documents_of, occurrences, op5_wavelet, read_ids, write_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n a", "a  b\t\tc \n", "I'll've don't'S x's", "x\x1cy z\x85w", "日本語 テキスト", "naïve ½² ǅ ɐbc", "<|endoftext|> a",
    "trailing \n", "a\xa0b \xa0 c", "tab\tb", " lead", "\r\n crlf\r\nx", "long" * 3000, "a​b c", "emoji 👍🏽 !?!", "é combining",
]


@pytest.fixture(scope="module")
def want():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_are_the_library_s(spark, sf, want):
    encode = encoder(PATH).encode
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rnd = random.Random(4)
    texts += ["".join(rnd.choice(" \n\t aB1.'ßé²") for _ in range(60)) for _ in range(500)]
    for text in texts:
        assert ids(encode(text)) == want(text), text
    for _ in range(2):
        found, n = encoder(PATH).encode_all(pa.array(texts, pa.string()).slice(3))
        assert found.tolist() == [i for t in texts[3:] for i in want(t)] and n.tolist() == [len(want(t)) for t in texts[3:]]
    assert [len(x) for x in encoder(PATH).encode_all(pa.array([], pa.string()))] == [0, 0]


def check_packed(rows, docs, encode, end):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, texts in docs.items():
        full = [encode(t) + [end] for t in texts]
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, full))
        if len(full) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(full[0]) and r.length > 0
                assert r.ids_crc32 == zlib.crc32(np.array(full[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    assert set(pieces) == set(docs)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, sf, want):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packed(op7_pack(spark, sf).collect(), docs, want, 1) < 2048
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, ""), (None, "x y")]
    d = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int").repartition(3)
    by = defaultdict(list)
    for k, t in rows:
        by[k].append(t)
    for pool in (1, 300, 1 << 20):
        assert check_packed(pack(d, PATH, pool=pool).collect(), by, want, 1) < 3 * 2048
    assert pack(d.limit(0), PATH).count() == 0
    named = pack(d.selectExpr("concat('d', doc_id) as doc_id", "text"), PATH)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and {r.doc_id for r in named.collect()} == {None if k is None else f"d{k}" for k, _ in rows}
    groups = step_groups([2048] * 10 + [256] * 16, 8192)
    sums = [sum(n for n, g in zip([2048] * 10 + [256] * 16, groups) if g == k) for k in set(groups)]
    assert max(sums) - min(sums) <= 2048


def test_wavelet_matrix():
    rnd = np.random.default_rng(5)
    for n, bits in ((0, 16), (1, 16), (63, 16), (512, 16), (513, 17), (5000, 16), (40000, 20)):
        x = rnd.zipf(1.3, n).clip(0, 65535).astype(np.uint32)
        w = WaveletMatrix.from_bytes(WaveletMatrix.of(x, bits).to_bytes())
        assert (w.ids() == x).all() and (w.access(np.arange(n)) == x).all()
        for token in {*x[:5].tolist(), 9, 65535}:
            for a, b in ((0, n), (n // 3, n // 2), (n, n)):
                where = np.flatnonzero(x[a:b] == token) + a
                assert w.count(token, a, b) == len(where) and (w.occurrences(token, a, b) == where).all()
        assert w.count(1 << 30) == 0 and not len(w.occurrences(-1))


def expected(rows, encode, end):
    out, at = [], 0
    for doc_id, text in rows:
        x = encode(text) + [end]
        out.append((doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


def test_round_trip(spark, sf, want):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op5_wavelet(spark, sf).collect())) == expected(docs, want, 0)
    rows = list(enumerate(ODD))
    d = spark.createDataFrame([(*r, 7) for r in rows + [(3, ODD[3]), (None, None)]], "doc_id long, text string, part int").repartition(5)
    for shard in (1, 100, 1 << 20):
        path = shared_dir(spark)
        write_ids(d, PATH, path, shard=shard)
        got = documents_of(read_ids(spark, path)).collect()
        full = [(None, None), *rows[:4], rows[3], *rows[4:]]
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(full, want, 0)
    path = shared_dir(spark)
    write_ids(d.limit(0), PATH, path)
    assert documents_of(read_ids(spark, path)).count() == 0


def test_queries_of_written_files(spark, sf, want):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) as doc_id", "text", "1 as position")
    docs = docs.union(docs.selectExpr("null", "null", "2")).union(docs.limit(5)).repartition(7)
    path = shared_dir(spark)
    write_ids(docs, PATH, path, shard=20000)
    shards = read_ids(spark, path)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    full = [(d, k, i) for d, t in rows for k, i in enumerate([*want(t), 0])]
    assert [r.doc_id for r in documents_of(shards).orderBy("start").collect()] == [d for d, _ in rows]
    everything = np.array([i for _, _, i in full])
    tokens = [0, 11, int(everything[-5]), 70000, -1, 0]
    for a, b in ((0, None), (30000, 90000), (10**9, None)):
        part = everything[a:b]
        assert {r.token: r.n for r in count(shards, tokens, a, b).collect()} in ({t: int((part == t).sum()) for t in tokens}, {})
        got = sorted((r.token, r.position, r.doc_id or "", r.at) for r in occurrences(shards, tokens, a, b).collect())
        assert got == sorted((t, int(p) + a, full[p + a][0] or "", full[p + a][1]) for t in set(tokens) for p in np.flatnonzero(part == t))
    asked = [0, 5, 5, len(full) - 1, len(full), -3, None, *range(19990, 20010), *range(0, len(full), 97)]
    got = access(shards, spark.createDataFrame([(p,) for p in asked], "position long"), cell=5000).collect()
    assert sorted((r.position, r.token) for r in got) == sorted((p, int(everything[p])) for p in {p for p in asked if p is not None and 0 <= p < len(full)})
    path = shared_dir(spark)
    write_ids(docs.limit(0), PATH, path)
    none = read_ids(spark, path)
    assert count(none, [1]).count() in (0, 1) and occurrences(none, [1]).count() == 0 and access(none, spark.range(3).withColumnRenamed("id", "position")).count() == 0

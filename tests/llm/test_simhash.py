import random
from itertools import combinations

import numpy as np
import xxhash

from brolga.llm.simhash import KINDS, SEGMENTS, Golay, fingerprint, keys, links, near_duplicates, op3_simhash

DOCS = "doc_id long, text string"


def plain(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, most=4):
    """rows: (doc_id, fingerprint)"""
    f = np.array([x for _, x in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= most):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_code_is_perfect():
    g = Golay()
    words = np.arange(0, 1 << 23, 977, dtype=np.int32)
    row, code, over = g.near(words)
    assert (np.bincount(row, weights=over == 0) == 1).all()


def test_every_error_pattern_has_a_kind():
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for n in range(1, 5):
        wrong = np.bitwise_or.reduce(bit[np.array(list(combinations(range(64), n)))], axis=1)
        found = np.zeros(len(wrong), bool)
        for segment, most, mask in KINDS:
            first, size = SEGMENTS[segment]
            inside = np.uint64(((1 << size) - 1) << first)
            assert not mask & int(inside)
            found |= (np.bitwise_count(wrong & inside) <= most) & (wrong & np.uint64(mask) == 0)
        assert found.all()


def test_keys_are_long_and_few():
    rnd = np.random.default_rng(5)
    f = rnd.integers(0, 1 << 63, 4000, np.int64).view(np.uint64) * np.uint64(2) + rnd.integers(0, 2, 4000).astype(np.uint64)
    row, key, own = keys(f)
    assert len(row) < 110 * len(f) and own.sum() == len(KINDS) * len(f)
    assert min(mask.bit_count() for _, _, mask in KINDS) + 12 >= 28


def test_close_fingerprints_share_a_key():
    rnd = random.Random(1)
    splits = [(i, j, k) for i in range(5) for j in range(5 - i) for k in range(5 - i - j)]

    def spoil(split):
        return sum(1 << at + b for n, (at, size) in zip(split, SEGMENTS) for b in rnd.sample(range(size), n))

    a = np.array([rnd.getrandbits(64) for _ in range(40 * len(splits))], np.uint64)
    b = np.array([int(x) ^ spoil(splits[i % len(splits)]) for i, x in enumerate(a)], np.uint64)
    of = []
    for f in (a, b):
        row, key, own = keys(f)
        of.append([{(int(k), bool(o)) for k, o in zip(key[row == i], own[row == i])} for i in range(len(f))])
    for x, y in zip(*of):
        assert any({(k, True), (k, False)} & y or (k, True) in y for k, o in x if o) or any((k, False) in x for k, o in y if o)


def test_edges_connect_as_brute_force(spark):
    rnd = random.Random(2)
    f = [rnd.getrandbits(64) for _ in range(300)]
    f += [x ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 5))) for x in f[:150] for _ in range(3)]
    centre = rnd.getrandbits(64)
    f += [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)][:900]
    f = sorted({x - (1 << 64) if x >> 63 else x for x in f})
    want = classes([(x, np.array(x, np.int64).view(np.uint64)) for x in f])
    for block, share in ((4096, 16), (50, 1), (5, 2)):
        from brolga.llm.common import components

        got = dict(components(links(spark.createDataFrame([(x,) for x in f], "fp long"), block, share)).collect())
        assert {x: got.get(x, x) for x in f} == want


def test_fingerprint_rule():
    for text in (None, "", " \t", "One", "one TWO three", "a b c d", "Ä ä Straße \x1c x y z q " * 9, "the " * 50):
        assert fingerprint(text) == plain(text)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (8, ""), (7, "x " * 30000)]
    docs = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], DOCS + ", fp string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = classes(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in rows}

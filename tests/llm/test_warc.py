import random

from pyspark.sql import functions as F

from brolga.llm.warc import PERMITTED, _cuts, canonical_url, resolve_revisits

COLUMNS = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_sha256 string, payload_length int, source string, own int"


def brute(rows, keys):
    out = []
    for r in rows:
        rid, url, ts, kind, headers, *_ = r
        if kind != "revisit":
            continue
        mine = {}
        for k, v in (headers or {}).items():
            mine.setdefault(k.lower(), v)
        key = keys[url]
        before = [x for x in rows if x[3] == "response" and key is not None and keys[x[1]] == key and None not in (x[2], ts) and (x[2], x[0]) < (ts, rid)]
        if not before:
            out.append((rid, key, "no_response", None, None, None, None))
            continue
        s = max(before, key=lambda x: (x[2], x[0]))
        theirs = {k.lower(): v for k, v in (s[4] or {}).items()}
        state = "unverified"
        if mine.get("etag") is not None and theirs.get("etag") is not None:
            state = "resolved" if mine["etag"].removeprefix("W/") == theirs["etag"].removeprefix("W/") else "changed"
        elif mine.get("last-modified") is not None and theirs.get("last-modified") is not None:
            state = "resolved" if mine["last-modified"] == theirs["last-modified"] else "changed"
        merged = theirs | {k: v for k, v in mine.items() if k in PERMITTED and v is not None}
        out.append((rid, key, state, s[0], *((tuple(sorted(merged.items())), s[5], s[6]) if state == "resolved" else (None, None, None))))
    return sorted(out, key=str)


def test_urls(spark):
    urls = ["HTTP://Ex.com:80/A/b/#x", "https://ex.com/A/b?", "https://ex.com:443/A/b?utm_x=1", "http://ex.com/?b=2&a=1", "//odd#f", "", None, "http://h:443/a", "HTTPS://h:80/a", "ftp://h:80"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == ["ex.com/A/b"] * 3 + ["ex.com?a=1&b=2", "//odd", "", None, "h:443/a", "h:80/a", "h:80"]


def test_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(600):
        kind = rnd.choice(["response", "revisit", "revisit", "metadata"])
        h = {n: rnd.choice(["1", "W/1", "2", None]) for n in rnd.sample(["ETag", "Last-Modified", "Date", "Content-Length", "Vary"], rnd.randint(0, 5))}
        url = rnd.choice(["http://a/x", "https://A/x/", "http://a/y", "http://b/?q=1&p=2", "http://b?p=2&q=1#t", None])
        rows.append((k, url, rnd.choice([None, *range(0, 500_000, 1700)]), kind, rnd.choice([h, h, None]), f"s{k}", k, "s", 1))
    rows += [(9999, "http://a/x", 400_000, "revisit", {"ETag": "1", "etag": "2"}, None, None, "s", 1)] * 2
    d = spark.createDataFrame(rows, COLUMNS).repartition(5)
    urls = {r[1] for r in rows}
    keys = dict(spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u"))).collect())
    for bucket, most in ((86_400, 10**5), (2_000, 10**5), (10**9, 10**5), (86_400, 3), (10**9, 7)):
        got = [(r[0], r[1], r[2], r[3], tuple(sorted(r[4].items())) if r[4] is not None else None, r[5], r[6]) for r in resolve_revisits(d, bucket=bucket, most=most).collect()]
        assert sorted(got, key=str) == brute(rows, keys)
    assert resolve_revisits(d.limit(0)).count() == 0


def test_crowded_minutes_are_cut(spark):
    """A full bucket is cut where its captures are, however they crowd; parts keep the order of time."""
    at = [0] * 3 + list(range(50_000, 50_060)) * 4 + [80_000] * 30
    d = spark.createDataFrame([("u", 0, t) for t in at] + [("v", 0, t) for t in range(9)], "url_key string, bucket long, ts long")
    cuts = {r.ts: r.start for r in _cuts(d, 20).where("url_key = 'u'").collect()}
    assert set(cuts) == set(at) and _cuts(d, 20).where("url_key = 'v'").count() == 0
    starts = [cuts[t] for t in sorted(cuts)]
    assert starts == sorted(starts) and all(cuts[t] <= t for t in cuts)
    sizes = {s: sum(1 for t in at if cuts[t] == s) for s in starts}
    assert max(n for s, n in sizes.items() if s != 80_000) <= 24 and len(sizes) >= 12

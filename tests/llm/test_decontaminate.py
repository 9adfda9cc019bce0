import random
import re

from brolga.llm.decontaminate import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for _, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            t = words(t)
            m = min(window, len(t))
            for p in range(len(t) - m + 1) if m else ():
                for q in range(len(w) - m + 1):
                    if w[q : q + m] == t[p : p + m]:
                        hit |= set(range(q, q + m))
                        ids.add(item)
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("ab cd ef gh İx ÉÄ 12 zz-Z".split()) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([14, 11, 10, 9, 3, 30, 1])] + [(7, None), (8, " .,"), (5, "q r")]
    docs = [(i, say(30) + " " + (items[i % 7][1] or "")[: rnd.randint(3, 60)].upper() + "! " + say(20)) for i in range(60)]
    docs += [(60, None), (61, ""), (61, ""), (None, items[0][1]), (62, (items[1][1] + " und ") * 3000)]
    want = brute(docs[:-1], items)
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, hits int")
    d = spark.createDataFrame([(*x, "y", 1) for x in docs], "doc_id long, text string, n string, hit_words int")
    for block in (10**6, 40):
        rows = decontaminate(d, b, block_words=block).collect()
        assert [(r.word_count, r.hit_words, r.hit_items) for r in rows][:-1] == want
        assert rows[-1].word_count == len(words(docs[-1][1])) and 1 in rows[-1].hit_items and rows[0].n == "y"
    empty = decontaminate(d, b.limit(0)).collect()
    assert [r.word_count for r in empty][:-1] == [x[0] for x in want] and not any(r.hit_words for r in empty)
    assert decontaminate(d.limit(0), b).count() == 0


def test_blocks_give_what_one_gives(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice("ab CD ef gh \u0130x \U0001d400z 12 zz-Z".split()) for _ in range(n))
    items = [(f"i{k}", say(n)) for k, n in enumerate([40, 25, 12, 10, 9, 2])] + [(None, say(15)), ("e", ""), ("i1", say(11))]
    docs = [(f"d{k}", say(20) + " " + (items[k % 9][1] or "") + " " + say(5)) for k in range(40)] + [(None, None), ("x", ""), ("d0", items[0][1])] * 2
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame([(*x, "t", "h") for x in docs], "doc_id string, text string, _text string, hits string").drop("_text")
    rows = lambda **k: sorted(map(tuple, decontaminate(d, b, **k).select("doc_id", "text", "hits", "hit_words", "hit_items", "word_count").collect()), key=str)
    whole = rows()
    want = sorted(((*x, n, h, sorted(i, key=lambda v: (v is not None, v))) for x, (n, h, i) in zip(docs, brute(docs, [(k or "null", t) for k, t in items]))), key=str)
    assert [(r[0], r[1], r[5], r[3], [v or "null" for v in r[4]]) for r in whole] == [(r[0], r[1], r[2], r[3], sorted(r[4], key=lambda v: (v != "null", v))) for r in want]
    assert rows(block_words=40) == whole
    assert any(None in r[4] for r in whole) and any("i0" in r[4] for r in whole)

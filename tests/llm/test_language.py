import math

import numpy as np

from brolga.llm.language import Models, fit, hashes, held_out, letters, op2_language, predict


def kneser_ney(text, order):
    """p(letter | letters before) by the textbook recursion over one text."""
    s = " " * (order - 1) + text
    grams = [s[i : i + order] for i in range(len(s) - order + 1)]
    counts = {order: {}}
    for g in grams:
        counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(h, w):
        n = len(h) + 1
        c = counts[n]
        once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = min(max((once + 1) / (once + 1 + 2 * (twice + 1)), 0.1), 0.95)
        lower = p(h[1:], w) if h else 1 / (len({g[-1] for g in grams}) + 1)
        total = sum(x for g, x in c.items() if g[:-1] == h)
        if not total:
            return lower
        kinds = sum(1 for g in c if g[:-1] == h)
        return max(c.get(h + w, 0) - d, 0) / total + min(d, 1) * kinds / total * lower

    return p


def test_probabilities_are_kneser_ney(spark):
    text = "the thin thing that then thinned the ten tents "
    model = fit(spark.createDataFrame([(text, "xx")], "text string, lang string"), order=3)
    p = kneser_ney(text, 3)
    for told in ("then", "zoo then", "hhh", "tent the"):
        s = "  " + told + " "
        want = -sum(math.log2(p(s[i - 2 : i], s[i])) for i in range(2, len(s))) / (len(s) - 2)
        got, n = model.entropies([told])
        assert n[0] == len(s) - 2 and abs(got[0, 0] - want) < 1e-9
    assert abs(sum(p("th", w) for w in set(text)) + p("th", "q") - 1) < 1e-9


def test_letters_and_bounds():
    chars, bounds = letters(["Ab, c", "", None, "É1é"], 3)
    said = ["".join(map(chr, chars[a:b])) for a, b in zip(bounds, bounds[1:])]
    assert said[0] == "  ab c " and said[3] == "  é é " and len(bounds) == 5
    assert hashes(chars[:3], 3)[2][2] == hashes(np.r_[chars[:1], chars[:3]], 3)[2][3]


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out()), rows=150)
    odd = [(1, None), (2, ""), (3, "123 ..."), (None, "the and of the other thing is"), (4, "の" * 400), (4, "x"), (5, "und " * 100000)]
    d = spark.createDataFrame([(a, b, "s", 0.5) for a, b in odd], "doc_id long, text string, lang string, score double")
    rows = predict(d, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.rejected for r in rows[:5]] == [True, True, True, False, True]
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].lang == "s" and rows[4].lang_pred in model.languages
    none = predict(d, Models([], 4)).collect()
    assert {r.lang_pred for r in none} == {"und"} and fit(d.limit(0)).languages == [] and predict(d.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_language(spark, sf).collect()
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(out) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.98
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_every_language_is_learned_and_copies_stay_in_bounds(spark):
    rnd = np.random.default_rng(15)
    rows = [(k, "".join(rnd.choice(list("abcdefgh"), 30)), f"l{k:02}") for k in range(30)]
    rows += [(100 + k, "one text said again and again", "xx") for k in range(3000)] + [(5000, "a " * 5000, "yy"), (5001, "b " * 5000, "yy")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(d, rows=50, most=4000)
    assert model.languages == sorted({r[2] for r in rows})
    got = predict(d, model).where("doc_id < 30").collect()
    assert all(r.lang_pred == r.lang for r in got)
    again = fit(d.repartition(5), rows=50, most=4000)
    assert all((a == b).all() for a, b in zip(model.grams, again.grams)) and model.usual == again.usual


def test_equal_entropies_take_the_first_name(spark):
    d = spark.createDataFrame([("the same words", "b"), ("the same words", "a"), ("das ist anders", "c")], "text string, lang string")
    row = predict(spark.createDataFrame([("the same",)], "text string"), fit(d)).first()
    assert row.lang_pred == "a" and row.score <= 0.5 + 1e-9


def test_prediction_against_brute_force(spark, sf):
    """Least cross-entropy by the textbook recursion over dictionaries, for languages of one text each."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and lang is not null").orderBy("doc_id").collect()]
    first = {}
    for r in docs:
        first.setdefault(r.lang, "".join(c if c.isalpha() else " " for c in r.text.lower())[:300])
    clean = {k: " ".join(v.split()) for k, v in first.items()}
    model = fit(spark.createDataFrame([(v, k) for k, v in clean.items()], "text string, lang string"), order=3)
    p = {k: kneser_ney(v + " ", 3) for k, v in clean.items()}
    letters_seen = len({c for v in clean.values() for c in v + " "}) + 1
    texts = [" ".join("".join(c if c.isalpha() else " " for c in r.text.lower()).split())[:60].strip() for r in docs[20:40]]
    got, _ = model.entropies(texts)
    for row, text in zip(got, texts):
        s = "  " + text + " "
        for k, name in enumerate(model.languages):
            told = [p[name](s[i - 2 : i], s[i]) for i in range(2, len(s))]
            own = len({c for c in clean[name] + " "}) + 1
            if own == letters_seen:
                assert abs(row[k] + sum(map(math.log2, told)) / len(told)) < 1e-9
    said = [r.lang_pred for r in predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert said == [model.languages[k] for k in got.argmin(1)]


def test_copies_are_drawn_by_their_share(spark):
    """Copies of one text alone, a third of all rows, and columns of any type."""
    d = spark.range(9000).selectExpr("id as doc_id", "'one text for all of them' as text", "'xx' as lang", "map('k', id) as extra")
    model = fit(d, rows=100)
    assert model.languages == ["xx"] and predict(d.limit(3), model).first().lang_pred == "xx"
    rnd = np.random.default_rng(3)
    rows = [("".join(rnd.choice(list("abcdefgh "), 20)), "yy") for _ in range(2000)] + [("zzzz", "yy")] * 1000
    model = fit(spark.createDataFrame(rows, "text string, lang string"), rows=300, order=2)
    z = math.log2(2) - model.log2([g[-1:] for g in hashes(np.array([ord("z"), ord("z")]), 2)])[0, 0]
    whole = fit(spark.createDataFrame(rows, "text string, lang string"), rows=10**6, order=2)
    other = math.log2(2) - whole.log2([g[-1:] for g in hashes(np.array([ord("z"), ord("z")]), 2)])[0, 0]
    assert abs(z - other) < 0.2

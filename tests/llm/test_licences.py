import random
import re

from brolga.llm.licences import CUES, TEMPLATES, Scanner, op8_licences, scan_licences, words

COLUMNS = "doc_id long, text string"
PROSE = "Ouwhea the of rend and threlyes of.\nThst of anonan, ha the."


def test_templates_are_found_and_told_apart(spark):
    rows = []
    for k, (name, texts) in enumerate(TEMPLATES.items()):
        for i, t in enumerate(texts):
            rows += [(100 * k + 10 * i, t), (100 * k + 10 * i + 1, f"{PROSE}\n\n/* {t} */\n{PROSE}")]
            wrapped = re.sub(r"((?:\S+ ){9})", r"\1\n", t)
            rows.append((100 * k + 10 * i + 2, f"Copyright (c) 2020 Somebody\n{wrapped}\n\n{PROSE}"))
    got = {}
    for r in scan_licences(spark.createDataFrame(rows, COLUMNS)).collect():
        got.setdefault(r.doc_id, {})[r.licence] = r
    names = list(TEMPLATES)
    for doc, text in rows:
        assert names[doc // 100] in got[doc] and got[doc][names[doc // 100]].missing == 0, (doc, text)
        assert set(got[doc]) == {names[doc // 100]}, (doc, set(got[doc]))


def test_wording_decides():
    s = Scanner()
    assert s.scan("Licensed under the Apache License, Version 1.1.") == [] and s.scan("a license to fish and the copyright of it") == []
    near = TEMPLATES["ISC"][0].replace("with or without fee", "with no fee")
    found = s.scan(near)
    assert [(r["licence"], r["missing"], r["extra"], r["differences"]) for r in found] == [("ISC", 2, 1, "-or without; +no")]
    assert near[found[0]["first"] : found[0]["last"]] + "." == near


def test_lines_length_and_number_do_not_matter():
    """Notices inside long lines, in long license-like texts, and many of them in one file."""
    s, rnd = Scanner(), random.Random(3)
    filler = [f"license{k}" if k % 50 == 0 else rnd.choice(PROSE.split()) for k in range(4000)]
    for name, texts in TEMPLATES.items():
        for t in texts:
            k = rnd.randrange(len(filler))
            found = s.scan(" ".join([*filler[:k], t, *filler[k:]]))
            assert name in {r["licence"] for r in found if not r["missing"]}, t
    full = [max(texts, key=len) for texts in TEMPLATES.values()]
    for joint in ("\n\n", " ", "\r"):
        found = s.scan(joint.join(re.sub(r"((?:\S+ ){9})", r"\1\n# ", t) for t in full))
        assert {r["licence"] for r in found} == set(TEMPLATES) and not any(r["missing"] for r in found)


def test_against_every_template_in_every_piece():
    """The ranking leaves nothing out: comparing all templates with all pieces word by word confirms no other licenses."""
    s, rnd = Scanner(), random.Random(8)
    parts = [t for texts in TEMPLATES.values() for t in texts] + [PROSE * 3, "license and copyright " * 9]
    for _ in range(25):
        text = " ".join(rnd.choice(parts) for _ in range(4))
        drop = [w for w in text.split() if rnd.random() > 0.01]
        said = words(" ".join(drop))
        want = set()
        for size in s.known:
            for a, b in s.pieces(len(said), list(range(len(said))), size):
                want |= {name for _, name, own in s.ranked(said[a:b], size) if s.differences(own, said[a:b])}
        found = s.scan(" ".join(drop))
        assert {r["template"] for r in found} <= want
        exact = {n.split("/")[0] for n in want if any(" ".join(words(t)) in " ".join(said) for t in TEMPLATES[n.split("/")[0]])}
        assert exact <= {r["licence"] for r in found}


def test_other_templates(spark):
    own = {"House": ["This text is the property of the house and no permission to copy it is given to anybody at all."]}
    d = spark.createDataFrame([(1, f"{PROSE} {own['House'][0]} {PROSE}"), (2, "Released under the MIT License.")], COLUMNS)
    assert sorted((r.doc_id, r.licence) for r in scan_licences(d, own).collect()) == [(1, "House"), (2, "MIT")]


def test_odd_rows(spark):
    long = (PROSE + "\n") * 3000 + "Released under the MIT License.\n" + (PROSE + "\n") * 3000
    rows = [(1, None), (2, ""), (3, long), (None, "Released under the MIT License."), (4, "license " * 20000), (3, long)]
    d = spark.createDataFrame([(*r, "z") for r in rows], COLUMNS + ", licence string")
    got = sorted((r.doc_id or 0, r.licence, r["first"]) for r in scan_licences(d).collect())
    at = long.index("Released")
    assert got == [(0, "MIT", 0), (3, "MIT", at), (3, "MIT", at)] and scan_licences(d.limit(0)).count() == 0


def test_query_against_plain_search(spark):
    """In the given documents, licenses are stated by short notices on lines of their own."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    said = {k: v for k, v in {
        "MIT": "under the MIT License", "Apache-2.0": "under the Apache License, Version 2.0", "GPL-3.0": "under the GNU General Public License, version 3",
        "CC-BY-NC-4.0": "under CC BY-NC 4.0",
    }.items()}
    want = {(d, k) for d, t in docs.items() for k, v in said.items() if re.search(CUES, t or "", re.I) and v in t}
    assert want and {(r.doc_id, r.licence) for r in op8_licences(spark, sf).collect()} == want

from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_recompress import brute as brute_cut
from tests.llm.test_simhash import classes, plain
from tests.llm.test_tokens_packing_wavelet import check_packed


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !", "en", "s", 7)], docs.schema)
    seen = docs.union(extra).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        before = seen.collect()
        after = stage(spark, seen, sf)
        rows = after.collect()
        if name == "packing":
            by = defaultdict(list)
            for r in before:
                by[r.doc_id].append(r.text)
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            check_packed(rows, by, lambda x: t.encode(x or "", add_special_tokens=False).ids, 1)
            break
        assert after.columns == docs.columns and rows
        if name == "language":
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows}
            assert {10**6, 10**6 + 1} <= gone and len(gone) < 5
        if name == "near_duplicate":
            of = classes([(r.doc_id, plain(r.text)) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(set(of.values()))
        if name == "substrings":
            want = brute_cut([r.text for r in before], 35)
            texts = {r.doc_id: r for r in rows}
            assert len(rows) == len(before)
            for r, (n, removed, _) in zip(before, want):
                now = texts[r.doc_id]
                assert len(now.text.encode().split()) == n - removed and (removed or now == r)
        if name == "benchmark":
            hits = brute_hits([(r.doc_id, r.text) for r in before], items)
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r, h in zip(before, hits) if not h[1])
        seen = spark.createDataFrame(rows, docs.schema)


def test_run_and_odd_columns(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as score", "text as kept_text", "1 as component", "1 as n_words", "2 as _key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_empty_and_null_tables(spark, sf, tmp_path):
    """run() on an empty documents table gives no rows; packing takes empty tables, nulls and clashing columns like the rest."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    name, packing = corpus_pipeline.STAGES[-1]
    assert name == "packing" and packing(spark, docs.limit(0), sf).count() == 0
    odd = docs.limit(3).union(spark.createDataFrame([(None,) * len(docs.columns)] * 2, docs.schema)).selectExpr("*", "1 as start", "2 as sequence_id")
    rows = packing(spark, odd, sf).collect()
    assert [r.doc_tokens for r in rows if r.doc_id is None] == [1, 1]


def test_many_equal_rows_long_texts_and_nested_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "map('k', struct(doc_id)) as nested", "array(map('a', 1)) as more", "1 as _row")
    one = docs.where("doc_id = 3")
    same = one.crossJoin(spark.range(4000)).drop("id").selectExpr(*[f"cast(null as long) as {c}" if c == "doc_id" else c for c in docs.columns])
    long = one.selectExpr(*["cast(77777 as long) as doc_id" if c == "doc_id" else "concat(repeat(concat(text, ' '), 3000), 'end') as text" if c == "text" else c for c in docs.columns])
    seen = docs.unionByName(same).unionByName(long)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.materialize(stage(spark, seen, sf))
        assert seen.columns == docs.columns
        if name == "language":
            assert seen.where("doc_id is null").count() == 4000
        if name == "near_duplicate":
            assert seen.where("doc_id is null").count() <= 1 and seen.where("doc_id = 77777").count() <= 1
    assert stage(spark, seen, sf).count() > 0

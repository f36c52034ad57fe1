"""The pipeline against its stages' brute-force versions on the smallest table."""

import corpus_pipeline
from logweave.llm import quality as quality_rules
from logweave.llm.common import with_row_key

from .test_operators import WORD, brute_near, brute_substring, ids_of, split


def test_stages_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "substring", "pack"]
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()

    keep = {r.doc_id for r in quality_rules.quality(docs).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    seen, unique = set(), []
    for i, t in rows:
        key = " ".join(split(" " + t + " "))
        if key not in seen:
            seen.add(key)
            unique.append((i, t))
    near = brute_near([t for _, t in unique], 5, 80)
    left = [x for k, x in enumerate(unique) if near[k][2]]
    removed = brute_substring([t for _, t in left], 50)
    assert {r.doc_id for r in packed} == {i for i, _ in left}
    _, ids = ids_of(WORD, [t for _, t in left], [1])
    for k, (i, _) in enumerate(left):
        total = sum(r.length for r in packed if r.doc_id == i)
        assert total <= len(ids[k]) and (total == len(ids[k])) == (removed[k][1] == 0)


def test_row_keys(spark):
    df = spark.createDataFrame([(5, "a"), (None, "b"), (7, "c"), (7, "d"), (None, "b")], "doc_id long, _key string")
    rows, key = with_row_key(df)
    got = {(r.doc_id, r["_key"], r[key]) for r in rows.collect()}
    assert key == "_key_" and len({k for _, _, k in got}) == 5 and (5, "a", 5) in got
    assert all(k > 7 for i, _, k in got if i != 5)
    empty, key = with_row_key(df.limit(0))
    assert empty.count() == 0


def test_stages_judge_rows_of_null_and_repeated_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = [r.text for r in quality_rules.quality(docs).filter("kept").join(docs.filter("lang = 'en'"), "doc_id").orderBy("doc_id").limit(4).collect()]
    a, b, c, d = good
    rows = [(1, "x", 1), (None, a, 2), (None, "y", 3), (9, b, 4), (9, "z", 5), (9, b, 6), (3, c, 7), (None, None, 8), (4, c, 9), (9, d, 10)]
    df = spark.createDataFrame([(i, t, "en", n) for i, t, n in rows], "doc_id long, text string, lang string, _cut int")
    kept = corpus_pipeline.quality(spark, df, "")
    assert kept.columns == df.columns and sorted(r["_cut"] for r in kept.collect()) == [2, 4, 6, 7, 9, 10]
    kept = corpus_pipeline.exact_copies(spark, kept, "")
    left = {r["_cut"] for r in kept.collect()}
    assert left in ({2, 4, 7, 10}, {2, 6, 7, 10})
    near = corpus_pipeline.near_copies(spark, kept, "")
    assert {r["_cut"] for r in near.collect()} == left
    same = corpus_pipeline.near_copies(spark, df, "")
    assert {r["_cut"] for r in same.collect()} >= {1, 2, 3, 5, 7, 8, 10} and same.count() == 8
    long = spark.createDataFrame([(9, a, 0), (9, "new " + a + " end", 1), (None, b, 2), (2, b, 3), (None, None, 4)], "doc_id long, text string, _doc int")
    out = {r["_doc"]: r for r in corpus_pipeline.repeated_passages(spark, long, "").collect()}
    assert out[0].text == a and out[1].text.split() == ["new", "end"] and out[3].text == b and out[2].text == "" and out[4].text is None
    assert out[0].doc_id == out[1].doc_id == 9 and out[2].doc_id is None


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0

"""Every operator over NULLs, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import exact_dedup, language_id, mixing, neighbours, packing, quality_crf, secret_scan, simhash_dedup, suffix_dedup, url_filter

CLASH = "tokens shard id a b level key p n rank root keep_id __len __head len head full lang_id probability start quality own dim bits count".split()
LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "Hello big wide world.\nThis is a line.", "en", "src0", 38),
    (None, None, None, None, None),
    (2, None, "en", "src0", 0),
    (3, "", None, "src1", 0),
    (4, " \n\t ", "en", None, 3),
    (5, LONG, "en", "src0", len(LONG)),
    (6, "Hello big wide world.\nThis is a line.", "en", "src1", 38),
    (6, "Hello big wide world.\nThis is a line.", "en", "src1", 38),
    (7, "a", "de", "src1", 1),
    (None, "No number has this text.", "en", "src0", 24),
    (8, "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\"", "en", "src0", 50),
    (9, "", "en", "src1", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in ROWS], SCHEMA + "".join(f", `{c}` string" for c in CLASH))
    return d.cache()


def ids(df):
    return sorted(((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect()))


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", [n for n in STAGES if n != "best-fit packing"])
def test_stages_keep_the_columns(spark, docs, name):
    out = STAGES[name](spark, docs, "")
    assert out.schema.fieldNames() == docs.columns
    assert out.count() <= docs.count()
    assert STAGES[name](spark, docs.limit(0), "").count() == 0


def test_op1(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (1, 1, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_crf.score(docs, quality_crf.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS)
    none = {r.doc_id for r in rows if r.quality is None}
    assert none == {None, 2, 3, 4, 9}
    assert all(not r.keep and r.n_lines == 0 and not any(r.good_lines) for r in rows if r.quality is None)
    assert next(r for r in rows if r.doc_id == 4).good_lines == [None, None]
    assert next(r for r in rows if r.doc_id == 1).n_lines == 2
    empty = quality_crf.fit(docs, labels.limit(0))
    assert {r.quality for r in quality_crf.score(docs.limit(3), empty).collect() if r.quality is not None} == {0.5}
    assert quality_crf.score(docs.limit(0), empty).count() == 0


def test_op2(spark):
    rows = [(1, [0.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [0.0, 0.0], "x"), (3, [9.0, 9.0], "x"), (4, None, "x"), (None, [1.0, 1.0], "x"), (5, [], "x"), (6, [float("nan"), 0.0], "x"), (7, [0.0, float("inf")], "x"), (8, [1.0], "x"), (9, [0.0, -1.0], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in neighbours.nearest(v, 2).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.distance))
    assert sorted(got[1]) == [(1, 3, 0.0), (2, 2, 1.0)]  # 2 and 9 tie: the smaller id
    assert sorted(got) == [1, 2, 3, 9]
    assert neighbours.nearest(v.limit(0)).count() == 0


def test_op3(spark, docs):
    assert suffix_dedup.repeats(docs).count() == 0  # the long text repeats within itself only
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def test_op4(spark, docs):
    rows = packing.pack(docs).collect()
    assert sum(r.tokens for r in rows if r.doc_id == 5) == 60_001
    assert [r.bin_id for r in rows if r.doc_id in (2, 3, 4, 9)] == [None] * 4
    assert packing.pack(docs.limit(0)).count() == 0


def test_op5(spark, docs):
    rows = language_id.identify(docs).collect()  # too few labelled rows for any language
    assert len(rows) == len(ROWS) and {r.lang_id for r in rows} == {"und"} and all(r.rejected for r in rows)


def test_op6(spark, docs):
    got = {(r.doc_id, r.keep_id, r.n_copies) for r in exact_dedup.groups(docs).collect()}
    assert got == {(1, 1, 2), (6, 1, 2), (3, 3, 2), (9, 3, 2)}
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)] * 2
    again = spark.createDataFrame([(1, "t"), (1, "t"), (1, "u"), (2, "u"), (2, "v")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.dedup(again).collect())) == [(1, "t"), (1, "u"), (2, "v")]
    same_head = spark.createDataFrame([(1, "h" * 300 + "a"), (2, "h" * 300 + "a"), (2, "h" * 300 + "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[-1]) for r in exact_dedup.dedup(same_head).collect()) == [(1, "a"), (2, "b")]
    assert exact_dedup.groups(docs.limit(0)).count() == 0 and exact_dedup.dedup(docs.limit(0)).count() == 0


def test_op7(spark, docs):
    got = {(r.doc_id, r.keep_id, r.n_near) for r in simhash_dedup.groups(docs).collect()}
    assert got == {(1, 1, 2), (6, 1, 2)}
    assert ids(simhash_dedup.dedup(docs)) == sorted(((r[0] is None, r[0] or 0) for r in ROWS if r[0] != 6))
    assert simhash_dedup.groups(docs.limit(0)).count() == 0


def test_op8(spark, docs):
    rows = secret_scan.secrets(docs.unionByName(docs.where("doc_id = 8"))).collect()
    assert [(r.doc_id, r.length, r.kind) for r in rows] == [(8, 40, "named")] * 2
    assert secret_scan.secrets(docs.limit(0)).count() == 0


def test_op9(spark):
    pages = spark.createDataFrame([(1, "http://www.cheap-pills.example.com/en/9x", "x"), (1, "http://www.cheap-pills.example.com/en/9x", "x"), (2, None, "x"), (3, " ", "x"), (4, "not a url", "x"), (None, "http://cheap-pills.example.com", "x"), (5, "http://notcheap-pills.example.com/" + "y" * 50_000, "x")], "page_id long, url string, key string")
    got = sorted(((r.page_id or 0, r.rule_id, r.action, r.n_rules) for r in url_filter.match(pages).collect()), key=str)
    assert got == sorted([(1, 7, "block", 3)] * 2 + [(2, None, "allow", 0), (3, None, "allow", 0), (4, None, "allow", 0), (0, 1, "block", 1), (5, None, "allow", 0)], key=str)
    assert url_filter.match(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "rule_id int, pattern string, action string")
    assert {r.action for r in url_filter.match(pages, none).collect()} == {"allow"}
    odd = spark.createDataFrame([(1, None, "block"), (2, "", "block"), (3, "b.c", "block"), (4, "b.c", "allow")], "rule_id int, pattern string, action string")
    one = spark.createDataFrame([(1, "http://a.b.c/")], "page_id long, url string")
    for kind in ("int", "string", "struct<a:int>"):
        typed = one.select((F.struct(F.lit(1).alias("a")) if "<" in kind else F.col("page_id").cast(kind)).alias("page_id"), "url")
        got = url_filter.match(typed, odd)
        assert got.dtypes[0] == ("page_id", kind) and got.first().rule_id == 3
    long = spark.createDataFrame([(1, "b.c/" + "p" * 3_000_000, "block"), (2, "c", "allow")], "rule_id int, pattern string, action string")
    far = spark.createDataFrame([(1, "http://a.b.c/"), (2, "http://b.c/" + "p" * 3_000_001)], "page_id long, url string")
    assert sorted((r.page_id, r.rule_id) for r in url_filter.match(far, long).collect()) == [(1, 2), (2, 1)]
    assert [(r.rule_id, r.action) for r in url_filter.match(one, odd).collect()] == [(3, "block")]


def test_op10(spark, docs):
    rows = mixing.sample(docs).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]  # two documents without a number
    assert sorted((r.tokens, r.source or "") for r in rows if r.doc_id is None) == [(0, ""), (5, "src0")]
    every = mixing.mix(docs, budget=1.0)
    assert every.columns == docs.columns and every.count() == len(ROWS)
    assert mixing.sample(docs.limit(0)).count() == 0
    assert not any(r.selected for r in mixing.sample(docs, {"src1": 0}).collect())

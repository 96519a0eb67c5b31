"""Postings made in Arrow batches against those of the plain plan."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import analyzer, batches, codec, html, sentiment
from quillon.operators import index as ix

TEXTS = ["S.T.A.R wi-fi it's a - b at&t 3.14 x.y-z", None, "", "the cat and the dog-cat", "a.b.c.d a--b .x. _-_ ä-ö б-в ½-3", "wi-fi wi fi " * 3, "&&& -.- ... #a-b $5.0"]
DOCS = [(1 if i == 5 else i, t, f"t{i} the-end") for i, t in enumerate(TEXTS)] + [(None, "no id wi-fi", "x")]


def _plain(occ, n):
    return sorted((r.token, r.doc_id or -1, list(r.hits)) for r in ix.postings(occ, n).collect())


def test_postings_of_batches_equal_those_of_the_plan(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, t string, u string")
    for a in (analyzer.DEFAULT, analyzer.Analysis(synonyms=("the, der", "wi-fi, wlan")), analyzer.Analysis(charset="0-9a-zа-я½_", dialect=False), analyzer.Analysis(blend_chars=()), analyzer.Analysis(separate_alnum=True)):
        for fields in (["t"], ["t", "u"]):
            got = batches.postings(docs, "doc_id", fields, a).collect()
            assert sorted((r.token, r.doc_id or -1, list(r.hits)) for r in got) == _plain(analyzer.occurrences(docs, "doc_id", fields, a), len(fields))


def test_a_document_in_several_batches_is_one():
    rows = [pa.RecordBatch.from_pydict({"doc_id": ids, "x0": [f"w{i}" for i in ids]}) for ids in ([None, 1, 1], [1], [1, 2], [2], [3, 4], [5])]
    got = [t.column("doc_id").to_pylist() for t in batches.whole_documents(iter(rows))]
    assert sum(got, []) == [None, 1, 1, 1, 1, 2, 2, 3, 4, 5]
    seen = [set(g) for g in got]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[i + 1 :])


def test_parts_equal_those_of_the_plan(spark):
    words = "s.t.a.r wi-fi at&t a.b a-.b x--y -a- ä-ö #a-b a_b-c a.b-c a-b.c ½-3 --- a-b- & 1.2.3 ab.c.d".split()
    d = spark.createDataFrame([(w,) for w in words], "t string").select("t", analyzer.blend_parts(F.col("t")).alias("p"))
    assert all(batches.parts_of(r.t, analyzer.DEFAULT) == list(r.p) for r in d.collect())


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    spark.range(100_000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    least = analyzer.partitions(spark)
    assert analyzer.partitions(spark, df) == least
    monkeypatch.setattr(analyzer, "PARTITION_BYTES", 1 << 10)
    assert analyzer.partitions(spark, df) > least


def test_prefixes_differ_without_a_shuffle(spark):
    words = ["aaaaaaa", "abcabcabc", "abc", "ab", "ääkköset", "x" * 25, "abcdefghij" * 3]
    df = spark.createDataFrame([(w,) for w in words], "token string").coalesce(1)
    for mode in (1, 2, 3):
        want = set()
        for w in words:
            n = min(len(w), 20)
            for c in range(1, n - 2):
                if mode < 3:
                    want.add((w[: n - c], w, c))
                if mode == 2:
                    want.add((w[c:], w, c))
                if mode == 3:
                    want |= {(w[f : f + n - c], w, c) for f in range(c + 1)}
        got = ix.prefixes(df, mode)
        rows = [tuple(r) for r in got.where("cutlen > 0").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_codecs_of_arrays_equal_those_of_lists():
    rnd = random.Random(1)
    lists = [[], None, [0], [127, 128], [5, 5, 9], [9, 3], [2, 0], [1 << 40, (1 << 40) + 1]] + [sorted(rnd.sample(range(1, 10**6), rnd.randrange(50))) for _ in range(50)]
    for rows in (lists, lists + [[1 << 62]], [None], [], [[]]):
        col = pa.array([None, *rows], pa.list_(pa.int64())).slice(1)
        data = [None if x is None else codec.delta_vb_encode(x) for x in rows]
        assert codec.delta_vb_encode_arrow(col).to_pylist() == data
        for coded in (data, [*data, b"\x01"]):  # the last ends within a number
            want = [None if x is None else codec.vb_delta_decode(x) for x in coded]
            assert codec.vb_delta_decode_arrow(pa.array(coded, pa.binary())).to_pylist() == want
            assert codec.vb_delta_max_arrow(pa.array(coded, pa.binary())).to_pylist() == [None if x is None else codec.vb_delta_max(x) for x in coded]


def test_codecs_in_a_plan(spark):
    df = spark.createDataFrame([([3, 70, 900],), ([],), (None,)], "ids array<bigint>").withColumn("data", codec.delta_vb_encode_udf("ids"))
    got = df.select("ids", codec.vb_delta_decode_udf("data").alias("back"), codec.vb_delta_max_udf("data").alias("top")).collect()
    assert [(r.ids, r.back, r.top) for r in got] == [([3, 70, 900], [3, 70, 900], 900), ([], [], 0), (None, None, None)]


SENTI = [(1, "A good day. It was the best of times, a waste of time!", "en"), (2, "well. done and dusted dr. e.g. bad :( ugly", "en"), (3, "huono päivä :) ihana", "fi"), (4, "nothing here to see at all", "en"), (5, None, "en"), (6, "good bad", "de"), (7, "well-done; well:done it", "en")]


def test_sentiment_with_and_without_a_first_look(monkeypatch):
    for _, text, lang in SENTI:
        if text:
            en = sentiment.lexicons()["fi" if lang == "fi" else "en"]
            got = sentiment.score_document(text, en)
            monkeypatch.setattr(sentiment, "FEW_ENTRIES", 0)
            assert got == sentiment.score_document(text, sentiment.lexicons()["fi" if lang == "fi" else "en"])
            monkeypatch.undo()


def test_scored_postings_equal_a_join(spark):
    docs = spark.createDataFrame(SENTI, "doc_id long, t string, lang string")
    words = docs.select("doc_id", F.explode(sentiment.document_sentiment(F.col("t"), F.col("lang"), 1001)["words"]).alias("token", "senti"))
    want = ix.postings(analyzer.occurrences(docs, "doc_id", ["t"]), 1, words)
    got = ix.tables(docs, ix.IndexSettings(fields=("t",), sentiment=1001, lang="lang"))["postings"]
    assert sorted((r.token, r.doc_id, r.hits, r.senti) for r in got.collect()) == sorted((r.token, r.doc_id, r.hits, r.senti) for r in want.collect())
    assert any(r.senti for r in got.collect()) and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_hits_of_documents_with_parts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, t string, u string").where("doc_id IS NOT NULL")
    occ = analyzer.occurrences(docs, "doc_id", ["t"])
    some = docs.select("doc_id", F.explode(analyzer.tokens(F.col("t"))).alias("w")).where(F.size(analyzer.blend_parts(F.col("w"))) > 0).select("doc_id").distinct()
    want = occ.join(some, "doc_id", "left_semi").groupBy("doc_id", F.col("pos").cast("long").alias("pos"), "token").agg(F.count("*").alias("n"))
    got = batches.blended(docs, "doc_id", "t", analyzer.DEFAULT)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pages_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    html.page_fields(F.col("html"))
    assert int(spark.conf.get(key)) == 4 << 20
    spark.conf.set(key, before) if before else None


def test_a_merge_with_a_document_that_became_empty(spark):
    old = spark.createDataFrame([(1, "red fox"), (2, "blue")], "doc_id long, t string")
    new = spark.createDataFrame([(1, "")], "doc_id long, t string")
    both = ix.merge_postings(ix.document_postings(old, "doc_id", ["t"]), ix.document_postings(new, "doc_id", ["t"]), new.select("doc_id"))
    assert {(r.token, r.doc_id) for r in both.collect()} == {("blue", 2)}

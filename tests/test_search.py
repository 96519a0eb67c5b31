"""Search over a few documents whose results were worked out by hand, and the catalog."""

import pytest

from quillon.cli import main
from quillon.functions import analyzer
from quillon.operators import index as ix
from quillon.operators.search import search
from quillon.plans.catalog import Catalog, CatalogError
from quillon.plans.query import Match, QueryError, Rank, SearchOptions
from quillon.sources import tables, web
from quillon.streaming import ingest

DOCS = [(1, "red fox runs", "alpha", 1), (2, "fox red", "beta", 2), (3, "blue bird", "red fox", None), (4, "the wi-fi s.t.a.r äiti", "", 2), (5, None, "gamma red", 0), (6, "red a fox", "red", 1)]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, body string, title string, kind int")
    s = ix.IndexSettings(fields=("body", "title"), attributes=("kind",), weights={"body": 2, "title": 1})
    i = ix.in_memory(docs, s)
    return ix.Index(s, i.postings.cache(), i.dictionary.cache(), i.prefixes.cache(), i.docinfo, i.documents)


def ids(r):
    return sorted(x.doc_id for x in r.all_hits.collect())


def test_tokens_and_blends(spark):
    d = spark.createDataFrame([(1, "S.T.A.R wi-fi it's a - b at&t"), (2, None), (3, "")], "doc_id long, t string")
    got = sorted((r.pos, r.token) for r in analyzer.occurrences(d, "doc_id", ["t"]).collect())
    assert got == sorted([(1, "s.t.a.r"), (1, "star"), (2, "wi-fi"), (2, "wi"), (3, "fi"), (3, "its"), (4, "a"), (5, "b"), (6, "at&t"), (6, "at"), (7, "t")])


def test_match_modes(index):
    assert ids(search(index, "red* fox*")) == [1, 2, 3, 6]
    assert ids(search(index, "red* fox*", SearchOptions(match=Match.ANY))) == [1, 2, 3, 5, 6]
    assert ids(search(index, "red* fox*", SearchOptions(match=Match.STRICT))) == [1, 3, 6]
    assert ids(search(index, "red* -blue")) == [1, 2, 5, 6]
    assert ids(search(index, '"red fox"')) == [1, 3]
    assert ids(search(index, "nowhere* red*")) == []
    assert ids(search(index, "nowhere* red*", SearchOptions(match=Match.ANY))) == [1, 2, 3, 5, 6]
    assert ids(search(index, "nowhere* red*", SearchOptions(match=Match.ANY, strict_missing=True))) == []
    assert ids(search(index, "")) == []


def test_scores(index):
    got = {r.doc_id: r.score for r in search(index, "red* fox*", SearchOptions(rank=Rank.PROXIMITY)).all_hits.collect()}
    assert got == {1: 4000, 2: 2000, 3: 2000, 6: 3000}  # body pair 2 + body 2; body; title pair + title; both fields


def test_weight_zero_hides_a_field(index):
    assert ids(search(index, "red* fox*", SearchOptions(weights={"body": 1, "title": 0}))) == [1, 2, 6]
    with pytest.raises(QueryError):
        search(index, "red", SearchOptions(weights={"body": 0, "title": 0}))


def test_expansion_and_accents(index):
    assert ids(search(index, "run")) == [1] and ids(search(index, "run*")) == []
    assert ids(search(index, "äiti")) == [4]
    assert ids(search(index, "star*")) == [4] and ids(search(index, "wi* fi*")) == [4]


def test_filters_groups_paging(index):
    o = SearchOptions(match=Match.ANY, filters={"kind": (1, 2)})
    assert ids(search(index, "red*", o)) == [1, 2, 6]
    assert ids(search(index, "red*", SearchOptions(filters={"!kind": (1,)}))) == [2, 3, 5]
    g = {r.attr_kind: r["count"] for r in search(index, "red*", SearchOptions(group_by="kind")).all_hits.collect()}
    assert g == {0: 2, 1: 2, 2: 1}  # NULL groups with 0
    whole = [r.doc_id for r in search(index, "red*").hits.collect()]
    pages = [r.doc_id for k in range(0, 6, 2) for r in search(index, "red*", offset=k, limit=2).hits.collect()]
    assert pages == whole


def test_catalog(spark, tmp_path, capsys):
    docs = spark.createDataFrame(DOCS, "doc_id long, body string, title string, kind int")
    c = Catalog(spark, str(tmp_path / "cat"))
    c.create("small", ix.IndexSettings(fields=("body", "title"), attributes=("kind",)))
    with pytest.raises(CatalogError):
        c.create("small", ix.IndexSettings(fields=("body",)))
    with pytest.raises(CatalogError):
        c.load("small")
    c.rebuild("small", docs.where("doc_id < 4"))
    m = c.add("small", docs)
    assert (m.documents, m.delta_documents, m.max_delta_id) == (3, 3, 6) and c.add("small", docs) == m
    assert ids(search(c.load("small"), "red* fox*")) == [1, 2, 3, 6]
    before = sorted(map(tuple, c.load("small").dictionary.select("token", "doc_matches", "n_hits").collect()))
    assert c.merge("small").documents == 6
    assert sorted(map(tuple, c.load("small").dictionary.select("token", "doc_matches", "n_hits").collect())) == before
    c.disable("small", spark.createDataFrame([(1,)], "doc_id long"))
    assert ids(search(c.load("small"), "red* fox*")) == [2, 3, 6]
    c.enable_all("small")
    c.rebuild_prefixes("small")
    main(["--catalog", str(tmp_path / "cat"), "search", "small", "red* fox*", "--limit", "2", "--filterby", "kind=1,2"], spark)
    assert capsys.readouterr().out.count("doc_id") == 2
    c.purge("small")
    assert c.manifest("small").documents == 0
    c.delete("small")
    assert c.names() == []


def test_source_problems(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", -2), (None, "c", None)], "id long, t string, k int")
    assert tables.problems(tables.split(d, ("k",))) == ["ids are missing", "ids repeat", "k is negative"]
    assert tables.problems(tables.split(d.select("t", "id"))) == ["t is not a whole number"]
    with pytest.raises(tables.SourceError):
        tables.split(d, ("nope",))
    assert tables.id_ranges(1, 10, 4) == [(1, 4), (5, 8), (9, 10)]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", "c")], "url string, link string")
    seeds = spark.createDataFrame([("a#top",)], "url string")
    assert {(r.url, r.depth) for r in web.crawl(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert web.crawl(edges, seeds.where("false")).count() == 0


def test_prefixes_stay_whole_when_a_rebuild_fails(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.create("a", ix.IndexSettings(fields=("body",)))
    docs = spark.createDataFrame(DOCS, "doc_id long, body string, title string, kind int")
    c.rebuild("a", docs.where("doc_id < 4"))
    c.add("a", docs)
    reader = c.load("a")
    before = sorted(map(tuple, reader.prefixes.collect()))
    write, calls = ix.write_prefixes, []

    def fail(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        write(*args)

    monkeypatch.setattr(ix, "write_prefixes", fail)
    with pytest.raises(RuntimeError):
        c.rebuild_prefixes("a")
    assert sorted(map(tuple, c.load("a").prefixes.collect())) == before
    monkeypatch.setattr(ix, "write_prefixes", write)
    c.rebuild_prefixes("a")
    assert sorted(map(tuple, c.load("a").prefixes.collect())) == before
    c.merge("a")
    assert sorted(map(tuple, reader.prefixes.collect())) == before  # the last manifest's folders stay for its readers
    assert sorted(map(tuple, c.load("a").prefixes.collect())) == before


def test_stream_documents_that_come_again(spark, tmp_path):
    s = ix.IndexSettings(fields=("body",))
    for n, rows in enumerate([[(1, "red fox"), (2, "blue fox")], [(2, "green bird"), (3, "red bird")], [(1, "red red")]]):
        ix.write(spark.createDataFrame(rows, "doc_id long, body string"), s, f"{tmp_path}/batch={n:010d}")

    def words(i):
        return {r.token: (r.doc_matches, r.n_hits) for r in i.dictionary.collect()}

    want = {"red": (2, 3), "green": (1, 1), "bird": (2, 2)}
    i = ingest.read(spark, s, str(tmp_path))
    assert words(i) == want and i.documents == 3 and ids(search(i, "red*")) == [1, 3]
    ingest.compact(spark, s, str(tmp_path))
    ix.write(spark.createDataFrame([(3, "blue")], "doc_id long, body string"), s, f"{tmp_path}/batch={3:010d}")
    i = ingest.read(spark, s, str(tmp_path))
    assert words(i) == {"red": (1, 2), "green": (1, 1), "bird": (1, 1), "blue": (1, 1)} and i.documents == 3
    assert words(ingest.read(spark, s, ingest.compact(spark, s, str(tmp_path)).rsplit("/", 1)[0])) == words(i)


def test_tokens_equal_the_normalised_text(spark):
    texts = ["Ünïted--&&x -a- .b. c&d&#13;e\r\nf\tg'h", "naïve $5 #tag ÄÖÅ дом 中文 a_b — “q”", "", None, "ﬁ \x00 \x7f ß İ"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    for a in (analyzer.DEFAULT, analyzer.Analysis(charset="0-9a-zа-я", dialect=False), analyzer.Analysis(blend_chars=(), separate_alnum=True)):
        rows = d.select(analyzer.tokens(d.t, a).alias("x"), analyzer.normalise(d.t, a).alias("y")).collect()
        assert all(r.x == [w for w in r.y.split(" ") if w not in a.forbidden] for r in rows)


def test_stream_of_a_table_in_one_file_or_several(spark, tmp_path):
    s = ix.IndexSettings(fields=("body",))
    rows = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "doc_id long, body string")
    rows.repartition(2).write.parquet(f"{tmp_path}/many.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("many", "one"):
        ingest.ingest(ingest.table(spark, f"{tmp_path}/{name}.parquet"), s, f"{tmp_path}/index-{name}", f"{tmp_path}/progress-{name}").awaitTermination()
        words = ingest.read(spark, s, f"{tmp_path}/index-{name}").dictionary.collect()
        assert {r.token: r.doc_matches for r in words} == {"red": 1, "fox": 2, "blue": 1}


def test_unseen_pages_of_one_url(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "a#x"), (3, "b"), (4, None)], "page_id long, url string")

    def left(stored):
        return sorted(r.page_id for r in web.unseen(pages, stored).collect())

    assert left(pages.where("url = 'b'")) == [1, 2]
    assert left(pages.where("url = 'a#x'")) == [3]
    assert left(pages.where("false")) == [1, 2, 3, 4]

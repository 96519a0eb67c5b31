"""The engine's queries over the driver's tables, each with its SQL where SQL can express it.

An index is built once a session into the shared folder and searched by many
queries, as in use; every query runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analyzer, batches, codec, html, linguistics, urls
from ..functions.sentiment import document_sentiment
from ..operators import index as ix
from ..operators.search import attach, expand, search
from ..operators.snippet import snippet
from ..operators.suggest import did_you_mean
from ..sources import tables, web
from ..streaming import ingest
from . import oracle as sql
from .catalog import Catalog, exists, shared_folder
from .query import Match, Rank, SearchOptions, Sort, parse

_INDEXES: dict[tuple, str] = {}
_LANGS = {"en": 1, "de": 3, "fr": 4, "es": 5}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name in the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read and write."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with whole-number attributes; quality and toxic are NULL without a label."""
    lang = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in _LANGS.items()], F.lit(0))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("source_n"), lang.alias("lang_n"))
    return docs.join(labels, "doc_id", "left")


SETTINGS = ix.IndexSettings(fields=("text",), attributes=("n_chars", "source_n", "lang_n", "quality", "toxic"))
PARTS = ix.IndexSettings(fields=("p_name", "p_brand", "p_type"), doc_id="p_partkey", attributes=("p_size",), weights={"p_name": 3, "p_brand": 2, "p_type": 1})


def _built(spark: SparkSession, sf_dir: str, name: str, s: ix.IndexSettings, make: Callable[[], DataFrame]) -> ix.Index:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _INDEXES.get(key)
    if path is None or not exists(spark, f"{path}/docinfo/_SUCCESS"):
        path = _INDEXES[key] = shared(spark, name)
        ix.write(make(), s, path)
    return ix.read(spark, s, path)


def doc_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of ``documents``."""
    return _built(spark, sf_dir, "documents", SETTINGS, lambda: corpus(spark, sf_dir))


def part_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of ``part``: three weighted fields."""
    return _built(spark, sf_dir, "part", PARTS, lambda: read(spark, sf_dir, "part"))


def _occ(spark, sf_dir, a=analyzer.DEFAULT):
    return analyzer.occurrences(read(spark, sf_dir, "documents"), "doc_id", ["text"], a)


_DOC = sql.occurrences("documents", "doc_id", ["text"])
_PART = sql.occurrences("part", "p_partkey", ["p_name", "p_brand", "p_type"])

# --- Sources and sinks --------------------------------------------------------

_SRC = "SELECT o.o_orderkey, c.c_name, n.n_name, o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


def _source(spark, sf_dir):
    tables.register(spark, sf_dir, "orders", "customer", "nation")
    return tables.sql_source(spark, _SRC, ("o_custkey",))


@_add("src_01_sql_source", _SRC)
def _(spark, sf_dir):
    return _source(spark, sf_dir).rows


@_add("src_02_split", f"SELECT o_orderkey AS doc_id, 0 AS field_id, c_name AS value FROM ({_SRC}) UNION ALL SELECT o_orderkey, 1, n_name FROM ({_SRC})")
def _(spark, sf_dir):
    s = _source(spark, sf_dir)
    parts = F.array(*[F.struct(F.lit(i).alias("field_id"), F.col(f).alias("value")) for i, f in enumerate(s.fields)])
    return s.rows.select(F.col(s.doc_id).alias("doc_id"), F.explode(parts).alias("x")).select("doc_id", "x.*")


@_add("src_03_ranges", "SELECT (o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 4096 AS range_no, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    parts = tables.in_ranges(orders, "o_orderkey", tables.id_ranges(low, high, 4096))
    return parts.groupBy("range_no").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@_add("src_04_modulo_shares", "SELECT doc_id % 4 AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    least = docs.agg(F.min("doc_id")).first()[0]
    whole = None
    for k in range(4):
        part = tables.share(docs, "doc_id", 4, k, least).withColumn("part", F.lit(k).cast("long"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@_add("src_05_incremental", "SELECT doc_id, n_chars FROM documents WHERE doc_id > (SELECT max(doc_id) * 3 // 4 FROM documents)")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    seen = docs.agg(F.floor(F.max("doc_id") * 3 / 4)).first()[0]
    return tables.newer(docs, "doc_id", seen)


_LINKS = r"""
anchors AS (SELECT regexp_replace(url, '#.*$', '') AS url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"#]+)[^"]*"', 1)) AS href FROM pages),
links AS (SELECT DISTINCT url, regexp_replace(CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN href
             WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1) || ':' || href
             ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1) || href END, '#.*$', '') AS link
          FROM anchors WHERE NOT regexp_matches(lower(href), '^(javascript|mailto|tel|data):'))"""


@_add("src_06_crawl", sql.query("SELECT url, min(depth) AS depth FROM walk GROUP BY url", "RECURSIVE " + _LINKS.strip(), "walk AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url, 0 AS depth FROM pages UNION SELECT links.link, depth + 1 FROM walk JOIN links USING (url) WHERE depth < 3)"))
def _(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return web.crawl(web.links(pages), pages.select("url"), depth=3)


@_add("snk_01_docinfo", sql.query("SELECT doc_id, n_chars AS attr_n_chars, source_n AS attr_source_n, lang_n AS attr_lang_n, quality AS attr_quality, toxic AS attr_toxic, 0 AS avgsentiscore FROM corpus", sql.CORPUS))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).docinfo


@_add("snk_03_query_log", "SELECT item_id::BIGINT AS results, text AS query, 2 AS searchmode FROM benchmark")
def _(spark, sf_dir):
    path = shared(spark, "log")
    rows = read(spark, sf_dir, "benchmark").select(F.col("text").alias("query"), F.col("item_id").cast("long").alias("results"), F.lit(2).alias("searchmode"), F.lit(0).cast("long").alias("querytime"), F.lit("").alias("ip"))
    tables.log_queries(rows, path)
    return spark.read.parquet(path).select("query", "results", "searchmode")


@_add("scn_01_posting_lookup", sql.query("SELECT token, doc_id, count(*) AS n_hits FROM occ WHERE token IN ('the', 'which', 'la') GROUP BY ALL", _DOC))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).postings.where(F.col("token").isin("the", "which", "la")).select("token", "doc_id", F.size("hits").cast("long").alias("n_hits"))


@_add("scn_02_prefix_lookup", sql.query("SELECT * FROM pre WHERE prefix IN ('the', 'ment', 'uber')", _DOC, sql.prefixes(1)))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).prefixes.where(F.col("prefix").isin("the", "ment", "uber"))


@_add("scn_03_metaphone_lookup")
def _(spark, sf_dir):
    word = "there"
    near = (F.col("metaphone") == linguistics.metaphone_int(word)) & F.octet_length("token").between(len(word) - 1, len(word) + 1)
    return doc_index(spark, sf_dir).dictionary.where(near).select("token", "doc_matches")


@_add("scn_04_result_rows", sql.query("SELECT doc_id, score, n_chars AS attr_n_chars, substring(text, 1, 150) AS title FROM hit JOIN documents USING (doc_id)", _DOC, sql.terms(["the", "with"], expand=False), sql.hits("documents", 2)))
def _(spark, sf_dir):
    hits = search(doc_index(spark, sf_dir), "the* with*").all_hits.select("doc_id", "score")
    info = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").alias("attr_n_chars"))
    return attach(hits, info, "text").select("doc_id", "score", "attr_n_chars", "title")


@_add("scn_05_original_rows", sql.query("SELECT doc_id, score, lang, source, n_chars FROM hit JOIN documents USING (doc_id)", _DOC, sql.terms(["of", "the"], expand=False), sql.hits("documents", 2)))
def _(spark, sf_dir):
    hits = search(doc_index(spark, sf_dir), "of* the*").all_hits.select("doc_id", "score")
    return tables.original_rows(hits, tables.split(read(spark, sf_dir, "documents"))).select("doc_id", "score", "lang", "source", "n_chars")


# --- Text and tokens ----------------------------------------------------------


@_add("txt_04_strip_tags", "SELECT page_id, regexp_replace(replace(replace(html, '<', ' <'), '>', '> '), '<[^>]*>', '', 'g') AS text FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.strip_tags(F.col("html")).alias("text"))


@_add("txt_05_html_to_text")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.to_text(F.col("html"), ("script", "style", "cdata"), ("a=href", "img=alt")).alias("text"))


@_add("txt_11_normalise", f"SELECT doc_id, {sql.normal('text')} AS text FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", analyzer.normalise(F.col("text")).alias("text"))


_ALNUM = analyzer.Analysis(separate_alnum=True)


@_add("txt_14_separate_alnum", f"SELECT doc_id, {sql.normal('text', _ALNUM)} AS text FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", analyzer.normalise(F.col("text"), _ALNUM).alias("text"))


@_add("txt_16_trim_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '(?i)the', '', 'g')) AS title FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", analyzer.trim_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1), ["the"]).alias("title"))


@_add("tok_01_tokens", sql.query("SELECT doc_id, pos, token FROM tok", _DOC))
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(analyzer.tokens(F.col("text"))).alias("i", "token"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "token")


@_add("tok_02_blend_parts", sql.query("SELECT doc_id, pos, token, count(*) AS n FROM occ WHERE doc_id IN (SELECT doc_id FROM blends) GROUP BY ALL", _DOC))
def _(spark, sf_dir):
    return batches.blended(read(spark, sf_dir, "documents"), "doc_id", "text", analyzer.DEFAULT)


_SYN = analyzer.Analysis(synonyms=("the, der, la", "and, und"))


@_add("tok_03_synonyms", sql.query("SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM occ WHERE token IN ('the', 'der', 'la', 'and', 'und') GROUP BY 1", sql.occurrences("documents", "doc_id", ["text"], _SYN)))
def _(spark, sf_dir):
    occ = _occ(spark, sf_dir, _SYN).where(F.col("token").isin("the", "der", "la", "and", "und"))
    return occ.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@_add("tok_05_query_parse")
def _(spark, sf_dir):
    asked = ['"of the" -and there*', "(with that) the", "s.t.a.r well-kept", 'broken " quote (and bracket']
    rows = [(text, t.q, t.token, t.group, t.negative, t.exact, list(t.keys)) for text in asked for t in parse(text, analyzer.DEFAULT, SearchOptions()).terms]
    return spark.createDataFrame(rows, "query string, q int, token string, grp int, negative boolean, exact boolean, expansion array<string>")


# --- Index --------------------------------------------------------------------

_DICT = "SELECT token, count(DISTINCT doc_id) AS doc_matches, max(doc_id) AS max_doc_id, count(*) AS n_hits FROM occ GROUP BY token"


@_add("idx_02_dictionary", sql.query(_DICT, _DOC))
def _(spark, sf_dir):
    return ix.dictionary(_post(read(spark, sf_dir, "documents")))


@_add("idx_02_postings", sql.query("SELECT token, doc_id, count(*) AS n_hits, min(pos) AS first_pos, max(pos) AS last_pos, sum(pos)::BIGINT AS pos_sum FROM occ GROUP BY ALL", _DOC))
def _(spark, sf_dir):
    h = F.col("hits")
    p = doc_index(spark, sf_dir).postings
    return p.select("token", "doc_id", F.size(h).cast("long").alias("n_hits"), F.element_at(h, 1).alias("first_pos"), F.element_at(h, -1).alias("last_pos"), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x).alias("pos_sum"))


@_add("idx_03_metaphone")
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).dictionary.select("token", "metaphone")


def _halves(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    middle = docs.agg(F.floor(F.max("doc_id") / 2)).first()[0]
    return docs.where(F.col("doc_id") <= middle), docs.where(F.col("doc_id") > middle)


def _post(docs):
    return ix.document_postings(docs, "doc_id", ["text"])


@_add("idx_04_merge", sql.query(_DICT, _DOC))
def _(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return ix.dictionary(ix.merge_postings(_post(old), _post(new), new.select("doc_id")))


@_add("idx_05_prefixes_1", sql.query("SELECT * FROM pre", _DOC, sql.prefixes(1)))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).prefixes


@_add("idx_05_prefixes_2", sql.query("SELECT * FROM pre", _DOC, sql.prefixes(2)))
def _(spark, sf_dir):
    return ix.prefixes(doc_index(spark, sf_dir).dictionary, 2)


@_add("idx_05_prefixes_3", sql.query("SELECT * FROM pre", _DOC, sql.prefixes(3)))
def _(spark, sf_dir):
    return ix.prefixes(doc_index(spark, sf_dir).dictionary, 3)


@_add("idx_06_folded_entries", sql.query("SELECT * FROM pre", _DOC, sql.prefixes(0)))
def _(spark, sf_dir):
    return ix.prefixes(doc_index(spark, sf_dir).dictionary, 0)


@_add("idx_07_prefix_sizes", sql.query("SELECT prefix, count(*) AS n_tokens, min(cutlen)::BIGINT AS least_cut, min(token) AS first_token FROM pre GROUP BY prefix", _DOC, sql.prefixes(1)))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).prefixes.groupBy("prefix").agg(F.count("*").alias("n_tokens"), F.min("cutlen").cast("long").alias("least_cut"), F.min("token").alias("first_token"))


@_add("idx_08_prefix_merge", sql.query("SELECT * FROM pre", _DOC, sql.prefixes(1)))
def _(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return ix.merge_prefixes(ix.prefixes(ix.dictionary(_post(old))), ix.prefixes(ix.dictionary(_post(new))))


def _delta(spark, sf_dir):
    """A catalog index of the first half of the documents, with the second half as a delta."""
    key = (spark.sparkContext.applicationId, sf_dir, "catalog")
    path = _INDEXES.get(key)
    if path is None or not exists(spark, f"{path}/docs/manifest.json"):
        path = _INDEXES[key] = shared(spark, "catalog")
        c = Catalog(spark, path)
        c.create("docs", ix.IndexSettings(fields=("text",)))
        old, _ = _halves(spark, sf_dir)
        c.rebuild("docs", old)
        c.add("docs", read(spark, sf_dir, "documents"))
    return Catalog(spark, path)


@_add("idx_09_delta_dictionary", sql.query(_DICT, _DOC))
def _(spark, sf_dir):
    return _delta(spark, sf_dir).load("docs").dictionary.drop("metaphone")


@_add("idx_13_rebuilt_prefixes", sql.query("SELECT * FROM pre", _DOC, sql.prefixes(1)))
def _(spark, sf_dir):
    c = _delta(spark, sf_dir)
    c.rebuild_prefixes("docs")
    return c.load("docs").prefixes


@_add("idx_14_statistics", "SELECT count(*) AS documents, min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents")
def _(spark, sf_dir):
    return ix.statistics(read(spark, sf_dir, "documents"))


@_add("adm_03_source_checks", "SELECT 'o_orderkey' AS source, 'none' AS problem UNION ALL SELECT 'c_nationkey', 'ids repeat'")
def _(spark, sf_dir):
    good = tables.split(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), ("o_custkey",))
    bad = tables.split(read(spark, sf_dir, "customer").select("c_nationkey", "c_name"))
    rows = [(s.doc_id, p) for s in (good, bad) for p in tables.problems(s) or ["none"]]
    return spark.createDataFrame(rows, "source string, problem string")


@_add("stm_01_stream_ingest", sql.query(_DICT, _DOC))
def _(spark, sf_dir):
    s, path = ix.IndexSettings(fields=("text",)), shared(spark, "stream")
    ingest.ingest(ingest.table(spark, f"{sf_dir}/documents.parquet"), s, path, shared(spark, "progress")).awaitTermination()
    return ingest.read(spark, s, path).dictionary.drop("metaphone")


# --- Codecs and hashes --------------------------------------------------------


def _ids(spark, sf_dir):
    """token, block, ids: sorted doc ids in blocks of ids, so that no row grows with a token's documents."""
    block = F.floor(F.col("doc_id") / codec.BLOCK).alias("block")
    return doc_index(spark, sf_dir).postings.groupBy("token", block).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


@_add("cod_03_posting_round_trip", sql.query("SELECT token, count(DISTINCT doc_id) AS n, max(doc_id) AS greatest, TRUE AS same FROM occ GROUP BY token", _DOC))
def _(spark, sf_dir):
    analyzer.small_batches(spark)  # a row may hold a block of ids
    coded = _ids(spark, sf_dir).withColumn("data", codec.delta_vb_encode_udf("ids"))
    each = coded.select("token", F.size("ids").cast("long").alias("n"), codec.vb_delta_max_udf("data").alias("greatest"), (codec.vb_delta_decode_udf("data") == F.col("ids")).alias("same"))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.max("greatest").alias("greatest"), F.bool_and("same").alias("same"))


@_add("cod_04_delta", sql.query("SELECT token, i - 1 AS i, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY token ORDER BY doc_id), 0) AS delta FROM (SELECT token, doc_id, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS i FROM (SELECT DISTINCT token, doc_id FROM occ))", _DOC))
def _(spark, sf_dir):
    order = Window.partitionBy("token").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    b = _ids(spark, sf_dir).withColumns({"from": F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)), "last": F.coalesce(F.lag(F.element_at("ids", -1)).over(order), F.lit(0).cast("long"))})
    d = b.select("token", "from", "last", F.posexplode(codec.delta_encode_column(F.col("ids"))).alias("i", "delta"))
    # The first of a block is a difference to the last of the block before.
    return d.select("token", (F.col("from") + F.col("i")).cast("long").alias("i"), (F.col("delta") - F.when(F.col("i") == 0, F.col("last")).otherwise(0)).alias("delta"))


@_add("cod_07_hash_keys", sql.query("SELECT DISTINCT token, ('0x' || substring(md5(token), 1, 4))::INT AS minichecksum FROM occ", _DOC))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).dictionary.select("token", codec.md5_head(F.col("token")).alias("minichecksum"))


@_add("cod_08_url_keys", "SELECT page_id, md5(url) AS url_checksum FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_checksum"))


# --- Linguistics --------------------------------------------------------------


@_add("lng_01_stems")
def _(spark, sf_dir):
    w = doc_index(spark, sf_dir).dictionary
    return w.select("token", linguistics.stem_english_udf("token").alias("english"), linguistics.stem_finnish_udf("token").alias("finnish"), linguistics.stem_keyword_udf("token").alias("keyword"))


# DuckDB counts bytes: a letter beyond ASCII, of which the word has none, is one other character there.
@_add("lng_07_levenshtein", sql.query("SELECT token, levenshtein(regexp_replace(token, '[^ -~]', '#', 'g'), 'there') AS distance FROM (SELECT DISTINCT token FROM occ)", _DOC))
def _(spark, sf_dir):
    return doc_index(spark, sf_dir).dictionary.select("token", F.levenshtein("token", F.lit("there")).cast("long").alias("distance"))


_ALL_FOLDS = analyzer.FOLDS


@_add("lng_09_folded_text", f"SELECT doc_id, translate(lower(text), '{''.join(_ALL_FOLDS)}', '{''.join(_ALL_FOLDS.values())}') AS folded FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", analyzer.fold(F.lower("text"), _ALL_FOLDS).alias("folded"))


# --- Web ----------------------------------------------------------------------


@_add("url_01_domain_info", r"""SELECT page_id, array_to_string(string_split(regexp_extract(url, '//([^/?#:]*)', 1), '.')[-2:], '.') AS domain,
    regexp_replace(array_to_string(string_split(regexp_extract(url, '//([^/?#:]*)', 1), '.')[:-3], '.'), '^www(\.|$)', '') AS subdomain FROM pages""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.domain_info_udf("url").alias("d")).select("page_id", "d.domain", "d.subdomain")


@_add("url_02_allowed_domains", r"SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '//([^/?#:]*)', 1), '(^|\.)example\.(com|net)$')")
def _(spark, sf_dir):
    return web.allowed(read(spark, sf_dir, "pages"), "url", ["*.example.com", "*.example.net"]).select("page_id", "url")


@_add("url_03_absolute_links", sql.query("SELECT url, link FROM links", _LINKS))
def _(spark, sf_dir):
    return web.links(read(spark, sf_dir, "pages"))


@_add("url_05_path", r"SELECT page_id, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*', '') AS path FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.remove_domain(F.col("url")).alias("path"))


@_add("url_07_keyword_check", "SELECT page_id, contains(url, 'example') AND contains(url, '/en/') AND NOT contains(url, 'www') AS ok FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", (urls.keyword_check(F.col("url"), "example -www") & urls.keyword_check(F.col("url"), "/en/")).alias("ok"))


@_add("url_08_compact_link", r"""
    SELECT page_id, CASE WHEN length(url) > 30 AND path <> '' THEN CASE WHEN length(short) > 30 THEN substring(short, 1, 30) || '...' ELSE short END ELSE url END AS link FROM (
        SELECT page_id, url, path, host || '/.../' || regexp_extract(path, '([^/]*)/*$', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS short FROM (
            SELECT *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages))""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.compact_link(F.col("url"), 30).alias("link"))


@_add("htm_01_links", sql.query("SELECT url, count(*) AS n_links FROM links GROUP BY url", _LINKS))
def _(spark, sf_dir):
    return web.links(read(spark, sf_dir, "pages")).groupBy("url").agg(F.count("*").alias("n_links"))


@_add("htm_03_page_fields")
def _(spark, sf_dir):
    return web.fields(read(spark, sf_dir, "pages"))


_RULES = [(1, "example.com /en/", "english"), (2, "/de/ -blog", "german"), (3, "example.org", "other")]


@_add("htm_04_categories", """SELECT category_id, count(*) AS n FROM (SELECT CASE
        WHEN (length(url) - length(replace(url, 'example.com', ''))) // 11 + (length(replace(url, 'example.com', '')) - length(replace(replace(url, 'example.com', ''), '/en/', ''))) // 4 >= 2 THEN 1
        WHEN contains(url, '/de/') AND NOT contains(url, 'blog') THEN 2 WHEN contains(url, 'example.org') THEN 3 ELSE 0 END AS category_id FROM pages) GROUP BY 1""")
def _(spark, sf_dir):
    return web.categories(read(spark, sf_dir, "pages"), _RULES).groupBy("category_id").agg(F.count("*").alias("n"))


@_add("htm_05_unseen_pages", "SELECT page_id, md5(regexp_replace(url, '#.*$', '')) AS url_checksum FROM pages WHERE regexp_replace(url, '#.*$', '') NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages WHERE contains(url, 'www'))")
def _(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return web.unseen(pages, pages.where(F.col("url").contains("www"))).select("page_id", "url_checksum")


@_add("htm_06_snapshots", r"SELECT doc_id, trim(regexp_replace(substring(text, 1, 5000), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS snapshot FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", html.snapshot(F.col("text")).alias("snapshot"))


# --- Search -------------------------------------------------------------------


def _search(name, text, o=SearchOptions(), oracle=None, cols=("doc_id", "score"), page=None, index=doc_index):
    def run(spark, sf_dir):
        r = search(index(spark, sf_dir), text, o, *(page or ()))
        return (r.hits if page else r.all_hits).select(*cols)

    _add(name, oracle)(run)


def _two(words, final="SELECT doc_id, score FROM hit", *, expand_=False, o=SearchOptions(), ctes=(), **kw):
    return sql.query(final, *ctes, _DOC, sql.terms(words, o, expand_), sql.hits("documents", len(words), **kw))


_search("qry_01_match_all", "the* with*", oracle=_two(["the", "with"]))
_search("qry_02_match_any", "des* the*", SearchOptions(match=Match.ANY), _two(["des", "the"], match="ANY"))
_search("qry_03_strict", "the* of*", SearchOptions(match=Match.STRICT), _two(["the", "of"], match="STRICT"))
_search("qry_04_not", "the* of* -with", SearchOptions(stemming=False), _two(["the", "of"], negative=("with",)))
_search("qry_05_phrase", '"of the"', oracle=_two(["of", "the"], adjacent=True))
_search("qry_06_bracket", "(of the)", oracle=_two(["of", "the"], expand_=True, adjacent=True))
_search("qry_07_exact_only", "there*", oracle=_two(["there"]))
_search("qry_08_expand", "there with", oracle=_two(["there", "with"], expand_=True))
_Q80 = SearchOptions(prefix_quality=80)
_search("qry_09_prefix_quality", "there with", _Q80, _two(["there", "with"], expand_=True, o=_Q80))


@_add("qry_10_stem_quality")
def _(spark, sf_dir):
    return search(doc_index(spark, sf_dir), "entering with", SearchOptions(stem_quality=75)).all_hits.select("doc_id", "score")


@_add("qry_11_expansion_terms", sql.query("SELECT token, q, quality, count(DISTINCT doc_id) AS matches FROM terms JOIN occ USING (token) GROUP BY ALL", _DOC, sql.terms(["there", "that"])))
def _(spark, sf_dir):
    i = doc_index(spark, sf_dir)
    o = SearchOptions()
    found = expand(i, parse("there that", i.settings.analysis, o), o)
    return spark.createDataFrame([(t.token, t.q, t.quality, t.matches) for t in found], "token string, q int, quality double, matches long")


_search("qry_12_repeated_word", "the* the*", oracle=_two(["the", "the"]))
_WEIGHTS = {"p_name": 3, "p_brand": 0, "p_type": 2}


def _part_sql(words, weights, **kw):
    return sql.query("SELECT doc_id, score FROM hit", _PART, sql.terms(words, expand=False), sql.hits("part", len(words), weights=weights, **kw))


_search("qry_13_field_weights", "red* economy*", SearchOptions(weights=_WEIGHTS, match=Match.ANY), _part_sql(["red", "economy"], (3, 0, 2), match="ANY"), index=part_index)
_search("qry_14_proximity", "red* widget*", SearchOptions(rank=Rank.PROXIMITY), _part_sql(["red", "widget"], (3, 2, 1), rank=3), index=part_index)
_search("qry_15_self_score", "small*", SearchOptions(rank=Rank.PROXIMITY), _part_sql(["small"], (3, 2, 1), rank=3), index=part_index)
_search("qry_16_bm25", "of* the*", SearchOptions(rank=Rank.BM25), _two(["of", "the"], rank=2))
_search("qry_17_rank_1", "that* with*", SearchOptions(rank=Rank.PROXIMITY_BM25), _two(["that", "with"], rank=1))
_search("qry_17_rank_2", "that* with*", SearchOptions(rank=Rank.BM25), _two(["that", "with"], rank=2))
_search("qry_17_rank_3", "that* with*", SearchOptions(rank=Rank.PROXIMITY), _two(["that", "with"], rank=3))
_search("qry_18_no_quality", "there with", SearchOptions(quality_scoring=False), _two(["there", "with"], expand_=True, quality=False))


@_add("qry_19_main_and_delta", _two(["of", "the"]))
def _(spark, sf_dir):
    return search(_delta(spark, sf_dir).load("docs"), "of* the*").all_hits.select("doc_id", "score")


@_add("qry_20_disabled", _two(["of", "the"], disabled="SELECT doc_id FROM labels WHERE toxic = 1"))
def _(spark, sf_dir):
    hidden = read(spark, sf_dir, "labels").where("toxic = 1")
    return search(doc_index(spark, sf_dir).with_disabled(hidden), "of* the*").all_hits.select("doc_id", "score")


def _filtered(where):
    return _two(["the", "of"], f"SELECT doc_id, score FROM hit JOIN corpus USING (doc_id) WHERE {where}", ctes=(sql.CORPUS,))


_search("qry_21_filter", "the* of*", SearchOptions(filters={"source_n": (1, 2, 3), "!quality": (0,)}), _filtered("source_n IN (1, 2, 3) AND coalesce(quality <> 0, TRUE)"))
_search("qry_22_range", "the* of*", SearchOptions(ranges={"n_chars": (500, 5000), "!source_n": (4, 9)}), _filtered("n_chars BETWEEN 500 AND 5000 AND coalesce(source_n <= 4 OR source_n >= 9, TRUE)"))


def _grouped(by, first, final):
    return _two(["the", "of"], final, ctes=(sql.CORPUS,)).replace("FROM grouped", f"FROM (SELECT *, count(*) OVER (PARTITION BY k) AS count, row_number() OVER (PARTITION BY k ORDER BY {first}, doc_id) AS r FROM (SELECT hit.*, coalesce({by}, 0) AS k, n_chars FROM hit JOIN corpus USING (doc_id))) WHERE r = 1")


_search("qry_23_group", "the* of*", SearchOptions(group_by="source_n"), _grouped("source_n", "score DESC", "SELECT doc_id, score, count, k AS attr_source_n FROM grouped"), cols=("doc_id", "score", "count", "attr_source_n"))
_search("qry_23_group_by_size", "the* of*", SearchOptions(group_by="quality", group_sort="n_chars asc"), _grouped("quality", "n_chars", "SELECT doc_id, score, count, k AS attr_quality FROM grouped"), cols=("doc_id", "score", "count", "attr_quality"))
_search("qry_24_sort_attribute", "the* of*", SearchOptions(sort=Sort.ATTRIBUTE, sort_by="n_chars desc"), _filtered("TRUE") + " ORDER BY n_chars DESC, doc_id LIMIT 25", page=(0, 25))
_search("qry_25_sort_by_count", "the* of*", SearchOptions(group_by="source_n", sort=Sort.ATTRIBUTE, sort_by="@count desc"), _grouped("source_n", "score DESC", "SELECT doc_id, count, k AS attr_source_n FROM grouped") + " ORDER BY count DESC, doc_id LIMIT 5", cols=("doc_id", "count", "attr_source_n"), page=(0, 5))
_search("qry_26_sort_by_id", "the* of*", SearchOptions(sort=Sort.ATTRIBUTE, sort_by="@id desc"), _two(["the", "of"]) + " ORDER BY doc_id DESC LIMIT 20", page=(0, 20))
_search("qry_27_sort_external", "the*", SearchOptions(sort=Sort.ATTRIBUTE, sort_by="source_n asc", filters={"!source_n": (0,)}), _two(["the"], "SELECT doc_id FROM hit JOIN corpus USING (doc_id) WHERE coalesce(source_n <> 0, TRUE) ORDER BY source_n NULLS FIRST, doc_id LIMIT 30", ctes=(sql.CORPUS,)), cols=("doc_id",), page=(0, 30))
_search("qry_28_page", "the* of*", oracle=_two(["the", "of"]) + " ORDER BY score DESC, doc_id LIMIT 15 OFFSET 10", page=(10, 15))


@_add("qry_30_did_you_mean")
def _(spark, sf_dir):
    i, o = doc_index(spark, sf_dir), SearchOptions()
    rows = []
    for text in ("thher wiht", "nicth", "the with"):
        q = parse(text, i.settings.analysis, o)
        rows.append((text, did_you_mean(i, text, q, expand(i, q, o))))
    return spark.createDataFrame(rows, "query string, suggestion string")


@_add("qry_31_snippets")
def _(spark, sf_dir):
    hits = search(doc_index(spark, sf_dir), '"of the"').all_hits.select("doc_id", "score")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(hits, "doc_id").select("doc_id", "score", snippet(F.col("text"), "of the").alias("snippet"))


# --- Sentiment ----------------------------------------------------------------


@_add("sen_03_document_sentiment")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", document_sentiment(F.col("text"), F.col("lang"), 1001).alias("s")).select("doc_id", F.col("s.total").alias("total"), F.size("s.words").alias("n_words"))


@_add("sen_05_sort_by_sentiment")
def _(spark, sf_dir):
    s = ix.IndexSettings(fields=("text",), sentiment=1001, lang="lang")
    i = _built(spark, sf_dir, "sentiment", s, lambda: read(spark, sf_dir, "documents"))
    return search(i, "the* of*", SearchOptions(sort=Sort.NEGATIVITY, senti_scale=60), limit=50).hits.select("doc_id", "score", "sentiscore")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express."""
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for two words, with rank."""
    hits = search(doc_index(spark, sf_dir), "the with").hits.select("doc_id", "score")
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))

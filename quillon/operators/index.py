"""Index build: occurrences to postings, dictionary and prefixes, all as DataFrames.

Postings are kept in long form, one row for each token and document with the
packed positions as an array, so no row grows with the collection; the
dictionary has one row a token.  Postings are partitioned by document, as they
come from the texts without a shuffle of their own, and sorted by token in each
partition: a query's ``token IN (...)`` prunes row groups, all files share the
work of a frequent token, and a document's hits are in one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches, linguistics
from ..functions.analyzer import Analysis, fold, partitions


@dataclass(frozen=True)
class IndexSettings:
    """How an index is built: fields and their weights, attributes, text analysis, prefixes.

    prefix_source: characters of a token from which prefixes are taken; 0 is all.
    """

    fields: tuple[str, ...]
    doc_id: str = "doc_id"
    attributes: tuple[str, ...] = ()
    weights: dict[str, int] = field(default_factory=dict)
    analysis: Analysis = Analysis()
    prefix_mode: int = 1
    prefix_length: int = 3
    prefix_source: int = 20
    sentiment: int = 0
    lang: str | None = None

    def weight(self, name: str) -> int:
        """Weight of a field, 1 by default."""
        return self.weights.get(name, 1)


def postings(occ: DataFrame, n_fields: int, sentiment: DataFrame | None = None) -> DataFrame:
    """token, doc_id, hits, senti: sorted array of pos * n_fields + field_id for each token and document.

    ``sentiment`` has (doc_id, token, senti), stored once a token and document.
    """
    packed = F.col("pos").cast("long") * n_fields + F.col("field_id")
    out = occ.groupBy("token", "doc_id").agg(F.sort_array(F.collect_list(packed)).alias("hits"))
    if sentiment is None:
        return out.withColumn("senti", F.lit(0))
    return out.join(sentiment, ["token", "doc_id"], "left").withColumn("senti", F.coalesce("senti", F.lit(0)))


def document_postings(docs: DataFrame, doc_id: str, fields: list[str], a: Analysis = Analysis()) -> DataFrame:
    """``postings`` of the documents' texts, grouped where they are taken apart; senti is 0."""
    return batches.postings(docs, doc_id, fields, a).withColumn("senti", F.lit(0))


def dictionary(post: DataFrame) -> DataFrame:
    """token, doc_matches, max_doc_id, n_hits."""
    return post.groupBy("token").agg(F.count("*").alias("doc_matches"), F.max("doc_id").alias("max_doc_id"), F.sum(F.size("hits")).alias("n_hits"))


def with_metaphone(words: DataFrame) -> DataFrame:
    """The dictionary with a metaphone column, computed once a token."""
    return words.withColumn("metaphone", linguistics.metaphone_udf("token"))


def prefixes(words: DataFrame, mode: int = 1, shortest: int = 3, analysis: Analysis = Analysis(), source: int = 20) -> DataFrame:
    """prefix, token, cutlen: parts of each token (``words`` has it once) of at least ``shortest`` characters.

    mode 0 none, 1 beginnings, 2 and endings, 3 all inner parts.  A token with
    accented letters of the charset also has its folded form, with cutlen 0.
    """
    t = words.select("token")
    capped = F.least(F.length("token"), F.lit(source)) if source else F.length("token")
    base = t.withColumn("len", capped)
    parts = []
    if mode:
        longer = base.where(F.col("len") > shortest)
        cut = longer.withColumn("cutlen", F.explode(F.sequence(F.lit(1), F.col("len") - shortest)))
        if mode in (1, 2):
            parts.append(cut.select(F.col("token").substr(F.lit(1), F.col("len") - F.col("cutlen")).alias("prefix"), "token", "cutlen"))
        if mode == 2:
            begin, end = F.col("token").substr(F.lit(1), F.col("len") - F.col("cutlen")), F.col("token").substr(F.col("cutlen") + 1, F.length("token"))
            parts.append(cut.where(begin != end).select(end.alias("prefix"), "token", "cutlen"))
        if mode == 3:
            inner = F.transform(F.sequence(F.lit(0), F.col("cutlen")), lambda k: F.col("token").substr(k + 1, F.col("len") - F.col("cutlen")))
            parts.append(cut.select(F.explode(F.array_distinct(inner)).alias("prefix"), "token", "cutlen"))
    if analysis.inside_folds:
        folded = fold(F.col("token"), analysis.inside_folds)
        parts.append(t.where(folded != F.col("token")).select(folded.alias("prefix"), "token", F.lit(0).alias("cutlen")))
    if not parts:
        return t.select(F.lit("").alias("prefix"), "token", F.lit(0).alias("cutlen")).where("false")
    # Entries are equal only within one token and length, so they differ by now, without a shuffle.
    return reduce(DataFrame.unionByName, parts)


def statistics(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """documents, min_id, max_id of the indexed rows."""
    return docs.agg(F.count("*").alias("documents"), F.min(doc_id).alias("min_id"), F.max(doc_id).alias("max_id"))


#: Ids of changed documents that may be broadcast to the old postings; above it a merge shuffles them.
BROADCAST_IDS = 4_000_000


def merge_postings(old: DataFrame, new: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Postings of both; where both have a document the new one counts.

    ``changed`` has the ids (doc_id) of the new documents where the caller has
    them beside the texts: else they are taken from the new postings.
    """
    changed = (new if changed is None else changed).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if changed.count() <= BROADCAST_IDS:
        changed = F.broadcast(changed)
    return old.join(changed, "doc_id", "left_anti").unionByName(new)


def merge_prefixes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both, once each."""
    return old.unionByName(new).distinct()


@dataclass(frozen=True)
class Index:
    """The tables of an index; all may be lazy."""

    settings: IndexSettings
    postings: DataFrame
    dictionary: DataFrame
    prefixes: DataFrame
    docinfo: DataFrame
    documents: int
    disabled: DataFrame | None = None

    def with_disabled(self, ids: DataFrame) -> Index:
        """An index that hides the documents (doc_id)."""
        ids = ids.select("doc_id").distinct()
        return Index(self.settings, self.postings, self.dictionary, self.prefixes, self.docinfo, self.documents, ids if self.disabled is None else self.disabled.union(ids).distinct())


def docinfo(docs: DataFrame, s: IndexSettings, senti: DataFrame | None = None) -> DataFrame:
    """doc_id, avgsentiscore and attributes as attr_ columns."""
    out = docs.select(F.col(s.doc_id).cast("long").alias("doc_id"), *[F.col(a).alias(f"attr_{a}") for a in s.attributes])
    return out.withColumn("avgsentiscore", F.lit(0)) if senti is None else out.join(senti, "doc_id", "left").withColumn("avgsentiscore", F.coalesce("avgsentiscore", F.lit(0)))


def tables(docs: DataFrame, s: IndexSettings) -> dict[str, DataFrame]:
    """Lazy postings, dictionary, prefixes and docinfo of the documents."""
    doc_scores = None
    if s.sentiment:
        from ..functions.sentiment import document_sentiment

        text, lang = F.concat_ws(". ", *s.fields), F.col(s.lang) if s.lang else F.lit(None)
        doc_scores = docs.select(F.col(s.doc_id).cast("long").alias("doc_id"), document_sentiment(text, lang, s.sentiment)["total"].alias("avgsentiscore"))
        post = batches.scored_postings(docs, s.doc_id, list(s.fields), s.analysis, text, lang, s.sentiment)
    else:
        post = document_postings(docs, s.doc_id, list(s.fields), s.analysis)
    words = dictionary(post)
    return {"postings": post, "dictionary": words, "prefixes": prefixes(words, s.prefix_mode, s.prefix_length, s.analysis, s.prefix_source), "docinfo": docinfo(docs, s, doc_scores)}


def write(docs: DataFrame, s: IndexSettings, path: str) -> None:
    """Builds the tables and writes them under ``path``; postings once, the rest from them."""
    t = tables(docs, s)
    write_tables(docs.sparkSession, s, t["postings"], t["docinfo"], path)


def write_tables(spark, s: IndexSettings, post: DataFrame, info: DataFrame, path: str) -> None:
    """Writes postings and docinfo under ``path``, and dictionary and prefixes from them."""
    post.sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    # Codes are computed a token at a time in Python: on all cores, however few bytes the dictionary has.
    words = dictionary(spark.read.parquet(f"{path}/postings")).repartition(partitions(spark), "token")
    with_metaphone(words).sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/dictionary")
    write_prefixes(spark, s, path, f"{path}/prefixes")
    info.write.mode("overwrite").parquet(f"{path}/docinfo")


def write_prefixes(spark, s: IndexSettings, path: str, target: str) -> None:
    """Writes the prefixes of the dictionary under ``path`` to ``target``."""
    words = spark.read.parquet(f"{path}/dictionary")
    entries = prefixes(words, s.prefix_mode, s.prefix_length, s.analysis, s.prefix_source)
    entries.repartition(partitions(spark, words), "prefix").sortWithinPartitions("prefix", "cutlen", "token").write.mode("overwrite").parquet(target)


def read(spark, s: IndexSettings, *paths: str, prefixes: dict[str, str] | None = None, documents: int | None = None) -> Index:
    """The index written under a path; several paths are a main index and its deltas, read together.

    ``prefixes`` names other folders for the prefixes of a path, ``documents``
    the number of documents where the caller knows it.
    """
    where = {k: [(prefixes or {}).get(p, f"{p}/{k}") if k == "prefixes" else f"{p}/{k}" for p in paths] for k in ("postings", "dictionary", "prefixes", "docinfo")}
    load = {k: spark.read.parquet(*ps) for k, ps in where.items()}
    words, pre = load["dictionary"], load["prefixes"]
    if len(paths) > 1:
        words = words.groupBy("token").agg(F.sum("doc_matches").alias("doc_matches"), F.max("max_doc_id").alias("max_doc_id"), F.sum("n_hits").alias("n_hits"), F.first("metaphone").alias("metaphone"))
        pre = pre.distinct()
    return Index(s, load["postings"], words, pre, load["docinfo"], load["docinfo"].count() if documents is None else documents)


def in_memory(docs: DataFrame, s: IndexSettings) -> Index:
    """An index of lazy tables, for small collections."""
    t = tables(docs, s)
    return Index(s, t["postings"], with_metaphone(t["dictionary"]), t["prefixes"], t["docinfo"], docs.count())

"""Keyword search as one lazy plan over the index tables.

The driver looks up the query's few tokens and their expansions; the rest is
declarative: a pruned scan of postings, a broadcast of the (bounded) term list,
one aggregation by document, and column arithmetic for adjacency and scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import fold
from ..plans.query import Match, Query, QueryError, Rank, SearchOptions, Sort, parse, parse_order
from .index import Index


@dataclass(frozen=True)
class Expansion:
    """A token that stands for query positions, with its quality for each."""

    token: str
    q: int
    quality: float
    matches: int


@dataclass
class Result:
    """A page of results and what belongs to it; DataFrames are lazy.

    hits: doc_id, score, sentiscore and attributes (count too, if grouped), in order.
    """

    hits: DataFrame
    all_hits: DataFrame
    query: Query
    terms: list[Expansion]
    missing: list[str] = field(default_factory=list)

    def total(self) -> int:
        """Number of matching documents, or groups."""
        return self.all_hits.count()


def expand(index: Index, query: Query, o: SearchOptions) -> list[Expansion]:
    """Dictionary tokens of the query: its words (quality 1) and up to ``expansion_limit`` expansions.

    Expansions come in the order (cutlen, token); quality is the share of the
    token that the key or the word leaves unedited.
    """
    exact = list(dict.fromkeys(t.token for t in query.terms))
    if not exact:
        return []
    owner: dict[str, str] = {}
    for t in query.terms:
        for k in t.keys:
            owner.setdefault(k, t.token)
    counts = {r.token: r.doc_matches for r in index.dictionary.where(F.col("token").isin(exact)).select("token", "doc_matches").collect()}
    found = [(w, w, 1.0) for w in exact if w in counts]
    if owner and o.expansion_limit:
        spark = index.dictionary.sparkSession
        keys = spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(owner.items())], "prefix string, word string, n int")
        e = index.prefixes.where(F.col("prefix").isin(list(owner))).join(F.broadcast(keys), "prefix").where(~F.col("token").isin(exact))
        folded = fold(F.col("token"), index.settings.analysis.inside_folds)
        e = e.where(F.col("token").contains(F.col("prefix")) | folded.contains(F.col("prefix")))
        if o.prefix_quality:
            size = F.length("prefix")
            e = e.where(F.round(size / (size + F.col("cutlen")) * 100) >= o.prefix_quality)
        first = e.groupBy("token").agg(F.min(F.struct("cutlen", "n", "prefix", "word")).alias("m")).select("token", "m.*").orderBy("cutlen", "token").limit(o.expansion_limit)
        size = F.length("token")
        quality = F.round((size - F.least(F.levenshtein("prefix", "token"), F.levenshtein("word", "token"))) / size, 3)
        rows = first.join(index.dictionary.select("token", "doc_matches"), "token").select("token", "word", quality.alias("quality"), "doc_matches", "cutlen").orderBy("cutlen", "token").collect()
        for r in rows:
            counts[r.token] = r.doc_matches
            found.append((r.token, r.word, r.quality))
    return [Expansion(tok, t.q, q, counts[tok]) for tok, word, q in found for t in query.terms if t.token == word and (not t.exact or tok == word)]


def _bit(q: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), q)


def _of_position(q: int):
    return lambda x: x["q"] == q


def _in_field(f: int, n: int):
    return lambda x: x % n == f


def _mask_weight(bits: list[Column], weights: list[int]) -> Column:
    total = F.lit(0)
    for b, w in zip(bits, weights):
        if w:
            total = total + F.when(b, F.lit(w)).otherwise(F.lit(0))
    return total


def score(index: Index, query: Query, terms: list[Expansion], o: SearchOptions) -> DataFrame:
    """doc_id, score, sentiscore of each matching document."""
    s = index.settings
    names = list(s.fields)
    weights = [(o.weights if o.weights is not None else s.weights).get(f, 0 if o.weights is not None else 1) for f in names]
    if not any(weights):
        raise QueryError("all data fields are disabled")
    n = len(names)
    spark = index.postings.sparkSession
    wanted = query.wanted
    rows = [(t.token, t.q, float(t.quality)) for t in terms]
    table = spark.createDataFrame(rows, "token string, q int, quality double")
    post = index.postings.where(F.col("token").isin(sorted({t.token for t in terms})))
    # A negated word's positions are never needed.
    negative = [t.q for t in query.terms if t.negative]
    hits = F.when(F.col("q").isin(negative), F.array().cast("array<bigint>")).otherwise(F.col("hits")) if negative else F.col("hits")
    g = post.join(F.broadcast(table), "token").groupBy("doc_id").agg(F.collect_list(F.struct("q", "quality", "senti", hits.alias("hits"))).alias("g"), F.bit_or(_bit(F.col("q"))).alias("bits"))

    required = sum(1 << t.q for t in wanted)
    forbidden = sum(1 << q for q in negative)
    if forbidden:
        g = g.where(F.col("bits").bitwiseAND(F.lit(forbidden)) == 0)
    if o.match != Match.ANY:
        g = g.where(F.col("bits").bitwiseAND(F.lit(required)) == required)
    if index.disabled is not None:
        g = g.join(index.disabled, "doc_id", "left_anti")

    # Hits of each position: all for the frequency, those of enabled fields for the rest.
    cols: dict[str, Column] = {}
    for t in wanted:
        own = F.filter("g", _of_position(t.q))
        cols[f"all{t.q}"] = F.array_sort(F.flatten(F.transform(own, lambda x: x["hits"])))
        cols[f"qual{t.q}"] = F.array_max(F.transform(own, lambda x: x["quality"]))
    g = g.select("doc_id", "bits", F.aggregate("g", F.lit(0), lambda a, x: a + x["senti"]).alias("senti"), *[c.alias(k) for k, c in cols.items()])
    disabled = [f for f, w in enumerate(weights) if not w]
    g = g.withColumns({f"h{t.q}": F.filter(f"all{t.q}", lambda x: ~(x % n).isin(*disabled)) if disabled else F.col(f"all{t.q}") for t in wanted})

    enabled = [f for f, w in enumerate(weights) if w]
    empty = F.array().cast("array<bigint>")
    g = g.withColumns({"prev": empty, "used": empty, "last": F.lit(-1), "pairs": F.lit(query.pairs).cast("long"), "chain": empty})
    for k, t in enumerate(wanted):
        here = F.col("bits").bitwiseAND(F.lit(1 << t.q)) != 0
        h = F.col(f"h{t.q}")
        # Positions of this word right after the word present before it, none used for an earlier pair.
        next_to = F.array_except(F.array_intersect(F.transform("prev", lambda x: x + n), h), F.col("used")) if k else empty
        g = g.withColumn("cand", F.coalesce(next_to, empty))
        bits = {f"adj{t.q}_{f}": F.exists("cand", _in_field(f, n)) for f in enabled}
        firsts = F.flatten(F.array(*[F.slice(F.array_sort(F.filter("cand", _in_field(f, n))), 1, 1) for f in enabled]))
        any_pair = F.size("cand") > 0
        seen = F.col("pairs").bitwiseAND(F.bitwise_not(_bit(F.greatest(F.col("last"), F.lit(0)))))
        new = {
            **bits,
            "used": F.concat("used", firsts),
            "pairs": F.when(any_pair & (F.col("last") >= 0), seen).otherwise(F.col("pairs")),
            "prev": F.when(here, h).otherwise(F.col("prev")),
            "last": F.when(here, F.lit(t.q)).otherwise(F.col("last")),
        }
        if o.contiguous:
            follow = k and t.group and t.group == wanted[k - 1].group
            new["chain"] = F.array_intersect(F.transform("chain", lambda x: x + n), h) if follow else h
            g = g.withColumns(new)
            if follow:
                g = g.where(F.size("chain") > 0)
        else:
            g = g.withColumns(new)
    if query.pairs:
        g = g.where("pairs = 0")

    field_hit = [F.lit(False)] * n
    for f in enabled:
        some = F.lit(False)
        for t in wanted:
            some = some | F.exists(f"h{t.q}", _in_field(f, n))
        field_hit[f] = some
    g = g.withColumn("self", _mask_weight(field_hit, weights).cast("long")).where("self > 0")
    if o.match == Match.STRICT and wanted:
        g = g.where(F.exists(f"h{wanted[0].q}", lambda x: F.floor(x / n) == 1))

    total = index.documents
    phrase, bm25, qual, present, extra = F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0).cast("long")
    for t in wanted:
        here = F.col("bits").bitwiseAND(F.lit(1 << t.q)) != 0
        w = _mask_weight([F.col(f"adj{t.q}_{f}") if weights[f] else F.lit(False) for f in range(n)], weights).cast("long")
        e = w - F.bit_count(w) + F.size(f"all{t.q}")
        df = min(total, sum(x.matches for x in terms if x.q == t.q))
        idf = math.log((total - df + 1) / df) / math.log(1 + total) if df else 0.0
        phrase = phrase + F.when(here, w).otherwise(F.lit(0))
        bm25 = bm25 + F.when(here, e * F.lit(idf) / (e + F.lit(1.2))).otherwise(F.lit(0.0))
        qual = qual + F.when(here, F.col(f"qual{t.q}")).otherwise(F.lit(0.0))
        present = present + F.when(here, F.lit(1)).otherwise(F.lit(0))
        extra = extra + F.when(here, w - F.bit_count(w)).otherwise(F.lit(0))
    near = (phrase + F.col("self")) * 1000
    part = F.round((F.lit(0.5) + bm25 / F.lit(2.0 * max(1, len(wanted)))) * 999)
    base = {Rank.PROXIMITY_BM25: near + part, Rank.BM25: part, Rank.PROXIMITY: near.cast("double")}[o.rank]
    quality = qual / F.greatest(present, F.lit(1)) if o.quality_scoring else F.lit(1.0)
    senti = F.col("senti") + (extra if o.sentiweight else F.lit(0))
    return g.select("doc_id", (base * quality).cast("long").alias("score"), senti.cast("long").alias("sentiscore"))


def _attribute(name: str) -> Column:
    return {"@id": F.col("doc_id"), "@score": F.col("score"), "@count": F.col("count"), "@sentiscore": F.col("sentiscore")}.get(name, F.col(f"attr_{name}"))


def apply_filters(hits: DataFrame, o: SearchOptions) -> DataFrame:
    """Hits that satisfy all filters and ranges; a NULL attribute satisfies negations only."""
    for name, values in o.filters.items():
        values = values if isinstance(values, (tuple, list, set)) else (values,)
        c = F.coalesce(_attribute(name.lstrip("!")).isin(*values), F.lit(False))
        hits = hits.where(~c if name.startswith("!") else c)
    for name, (low, high) in o.ranges.items():
        a = _attribute(name.lstrip("!"))
        c = (a <= low) | (a >= high) if name.startswith("!") else a.between(low, high)
        hits = hits.where(F.coalesce(c, F.lit(name.startswith("!"))))
    return hits


def group(hits: DataFrame, o: SearchOptions) -> DataFrame:
    """The best hit of each value of the attribute, with the number of hits; NULL groups with 0."""
    if o.group_by is None:
        return hits
    by, up = parse_order(o.group_sort)
    key = F.coalesce(F.col(f"attr_{o.group_by}"), F.lit(0))
    if by == "@count":
        by = "@score"
    a = _attribute(by)
    # As one row is taken from each group, aggregates combine before the shuffle, whatever a group's size.
    first = F.struct(a.isNotNull(), a, "doc_id") if up else F.struct(a.isNull(), -a, "doc_id")
    kept = [c for c in hits.columns if c != f"attr_{o.group_by}"]
    out = hits.groupBy(key.alias(f"attr_{o.group_by}")).agg(F.min_by(F.struct(*kept), first).alias("best"), F.count("*").alias("count"))
    return out.select("best.*", f"attr_{o.group_by}", "count")


def order(hits: DataFrame, o: SearchOptions) -> DataFrame:
    """Hits in order, ties by doc_id."""
    if o.sort_by and o.sort in (Sort.ATTRIBUTE, Sort.RELEVANCE):
        by, up = parse_order(o.sort_by)
        a = _attribute(by)
        return hits.orderBy(a.asc() if up else a.desc(), *([] if by == "@id" else ["doc_id"]))
    if o.sort == Sort.POSITIVITY:
        return hits.orderBy(F.desc("sentiscore"), F.desc("score"), "doc_id")
    if o.sort == Sort.NEGATIVITY:
        return hits.orderBy(F.asc("sentiscore"), F.desc("score"), "doc_id")
    return hits.orderBy(F.desc("score"), "doc_id")


def blend_sentiment(hits: DataFrame, query: Query, index: Index, o: SearchOptions) -> DataFrame:
    """sentiscore mixed from that of the passages and that of the document."""
    weights = (o.weights or {}).values() if o.weights is not None else [index.settings.weight(f) for f in index.settings.fields]
    top = len(query.wanted) * sum(weights) * 1000 + 999
    if o.senti_scale is None:
        mixed = F.col("score") / top * F.col("avgsentiscore") + (top - F.col("score")) / top * F.col("sentiscore")
    elif o.senti_scale == 100:
        mixed = F.col("avgsentiscore")
    elif o.senti_scale == 0:
        mixed = F.col("sentiscore")
    else:
        share = round(o.senti_scale / 100, 2)
        mixed = F.col("avgsentiscore") * share + F.col("sentiscore") * abs(share - 1.0)
    return hits.withColumn("sentiscore", mixed.cast("long"))


def search(index: Index, text: str, options: SearchOptions | None = None, offset: int = 0, limit: int = 10) -> Result:
    """Runs a query; an offset or limit below its least value falls back to the default."""
    attributes = {c[5:] for c in index.docinfo.columns if c.startswith("attr_")}
    o = (options or SearchOptions()).check(attributes)
    offset, limit = offset if offset >= 0 else 0, limit if limit > 0 else 10
    query = parse(text, index.settings.analysis, o, index.settings.prefix_length)
    terms = expand(index, query, o)
    have = {t.q for t in terms}
    missing = [t.token for t in query.wanted if t.q not in have]
    hits = score(index, query, terms, o)
    if not query.wanted or (missing and (o.match != Match.ANY or o.strict_missing)):
        hits = hits.where("false")
    senti = o.sort in (Sort.POSITIVITY, Sort.NEGATIVITY) or "@sentiscore" in f"{o.sort_by} {o.group_sort}"
    used = {n.lstrip("!") for n in [*o.filters, *o.ranges]} | ({o.group_by} if o.group_by else set()) | {parse_order(e)[0] for e in [o.group_sort, *([o.sort_by] if o.sort_by else [])]}
    if senti or used & attributes:
        hits = hits.join(index.docinfo, "doc_id")
        if senti:
            hits = blend_sentiment(hits, query, index, o)
        hits = hits.drop("avgsentiscore")
    full = group(apply_filters(hits, o), o)
    page = order(full, o)
    page = page.offset(offset) if offset else page
    return Result(page.limit(limit), full, query, terms, missing)


def attach(hits: DataFrame, docinfo: DataFrame, title: str | None = None) -> DataFrame:
    """Hits with their stored row; a title is cut to 150 characters."""
    out = hits.join(docinfo, "doc_id")
    return out.withColumn("title", F.substring(title, 1, 150)) if title else out

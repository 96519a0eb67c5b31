"""URL filter rules as a sort-merge range join on reversed-host keys.

A URL becomes a key like ``com,example,www,/path?query``; a rule for a host
(all its subdomains) or for a host and path is a prefix of such keys, hence an
interval of their order.  Keys and rules are cut at common borders, a rule
going to each range that its interval meets, sorted as bytes, and swept once
with a stack of the rules that enclose the current key.  A rule is two events,
its start and its end (a byte that no key holds after the prefix); between two
events the stack stays as it is, so the pages there are decided at once.  The
longest rule decides; among equal prefixes the smallest rule_id.

Defined results: a NULL, blank or malformed URL (no ``//host``) meets no rule
and is allowed; repeated pages give repeated rows; an empty rule table allows
all; rules with a NULL or malformed pattern match nothing; page_id is of any
type and passes through; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: (rule_id, pattern, action) used where the caller gives no rule table.
DEFAULT_RULES = [
    (1, "cheap-pills.example.com", "block"),
    (2, "spam-farm.example.org", "block"),
    (3, "casino-win.example.org", "block"),
    (4, "ads-track.example.org", "block"),
    (5, "free-bets.example.com", "block"),
    (6, "www.cheap-pills.example.com/en/", "allow"),
    (7, "www.cheap-pills.example.com/en/9", "block"),
    (8, "m.free-bets.example.com", "allow"),
    (9, "example.net", "allow"),
    (10, "blog.ththan.example.net", "block"),
    (11, "blog.ththan.example.net/en/", "allow"),
]
#: Keys from which the borders of the ranges are taken; they move no result.
SAMPLE = 8192
_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)"
_REST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^#\s]*)"


def key(url):
    """Reversed-host key of a URL column; NULL where there is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    rest = F.regexp_extract(url, _REST, 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), rest))


def rule_prefixes(rules: DataFrame) -> DataFrame:
    """rule_id, action, prefix of each usable rule; one rule for each prefix."""
    url = F.concat(F.lit("//"), F.regexp_replace(F.trim("pattern"), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//|^\*\.", ""))
    k = key(url)
    whole = ~url.substr(F.lit(3), F.length(url)).contains("/")
    prefix = F.when(whole, F.regexp_replace(k, "/$", "")).otherwise(k)
    return rules.select("rule_id", "action", prefix.alias("prefix")).where("prefix IS NOT NULL").groupBy("prefix").agg(F.min(F.struct("rule_id", "action")).alias("r")).select("r.*", "prefix")


#: Kinds of rows in the order of equal keys.
_START, _PAGE, _END = 0, 1, 2


def sweep(batches):
    """Yields page_id, url, rule_id, n_rules of the pages of one range; rows are sorted by key and kind."""
    stack: list[int] = []
    for b in batches:
        kind, rules = b.column("kind").to_numpy(), b.column("rule_id")
        rule, depth = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
        at = 0
        for e in [*np.flatnonzero(kind != _PAGE).tolist(), len(b)]:
            rule[at:e], depth[at:e] = stack[-1] if stack else 0, len(stack)
            if e < len(b):
                if kind[e] == _START:
                    stack.append(rules[e].as_py())
                else:  # nested prefixes end in the reverse order of their starts
                    stack.pop()
            at = e
        pages = kind == _PAGE
        take = pa.array(pages)
        yield pa.RecordBatch.from_arrays([b.column("page_id").filter(take), b.column("url").filter(take), pa.array(rule[pages], mask=depth[pages] == 0), pa.array(depth[pages])], ["page_id", "url", "rule_id", "n_rules"])


def match(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, url, rule_id, action, n_rules for each row of ``pages``."""
    spark = pages.sparkSession
    common.small_batches(spark)
    if rules is None:
        rules = spark.createDataFrame(DEFAULT_RULES, "rule_id int, pattern string, action string")
    keyed = pages.select("page_id", "url", F.encode(key(F.col("url")), "UTF-8").alias("key"))
    known = keyed.where("key IS NOT NULL")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    some = sorted(bytes(r[0]) for r in common.hash_sample(known.select("key", F.hash("page_id").alias("h")), SAMPLE, "key", "h").collect())
    bounds = np.array(sorted({some[len(some) * i // n] for i in range(1, n)}) if some else [], object)

    def place(batches):
        for b in batches:
            k = np.array([*b.column("key").to_pylist(), None], object)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, k, "right").astype(np.int32)), *(b.column(c) for c in ("key", "page_id", "url"))], ["shard", "key", "page_id", "url"])

    def reach(batches):
        for b in batches:
            p = b.column("prefix").to_pylist()
            lo, hi = (np.searchsorted(bounds, np.array([*(x + end for x in p), None], object)[:-1], "right").tolist() for end in (b"", b"\xff"))
            yield pa.RecordBatch.from_arrays([pa.array([list(range(x, y + 1)) for x, y in zip(lo, hi)], pa.list_(pa.int32())), b.column("prefix"), b.column("rule_id")], ["shards", "prefix", "rule_id"])

    kind = dict(keyed.dtypes)["page_id"]
    prefixes = rule_prefixes(rules).withColumn("rule_id", F.col("rule_id").cast("long"))
    active = prefixes.select(F.encode("prefix", "UTF-8").alias("prefix"), "rule_id").mapInArrow(reach, "shards array<int>, prefix binary, rule_id long")
    ends = F.array(F.struct(F.col("prefix").alias("key"), F.lit(_START).alias("kind")), F.struct(F.concat("prefix", F.unhex(F.lit("FF"))).alias("key"), F.lit(_END).alias("kind")))
    active = active.select(F.explode("shards").alias("shard"), "prefix", "rule_id").select("shard", F.explode(ends).alias("e"), "rule_id")
    active = active.select("shard", "e.key", "e.kind", F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), "rule_id")
    there = known.select("key", "page_id", "url").mapInArrow(place, f"shard int, key binary, page_id {kind}, url string").select("shard", "key", F.lit(_PAGE).alias("kind"), "page_id", "url", F.lit(None).cast("long").alias("rule_id"))
    both = active.unionByName(there).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("key", "kind")
    hits = both.select("kind", "page_id", "url", "rule_id").mapInArrow(sweep, f"page_id {kind}, url string, rule_id long, n_rules int")
    hits = hits.unionByName(keyed.where("key IS NULL").select("page_id", "url", F.lit(None).cast("long").alias("rule_id"), F.lit(0).alias("n_rules")))
    actions = common.cut(prefixes.groupBy("rule_id").agg(F.min("action").alias("action")))
    return hits.join(common.sized(actions), "rule_id", "left").select("page_id", "url", "rule_id", F.coalesce("action", F.lit("allow")).alias("action"), "n_rules")


def op9_url_filter(spark, sf_dir):
    """The deciding rule of every page of ``pages``."""
    return match(common.read(spark, sf_dir, "pages"))


def _rules_sql() -> str:
    return ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in DEFAULT_RULES)


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {
    "op9_url_filter": rf"""
        WITH rules(rule_id, pattern, action) AS (VALUES {_rules_sql()}),
        parts AS (SELECT 0 AS is_rule, page_id AS id, url, url AS u FROM pages
                  UNION ALL SELECT 1, rule_id, pattern, '//' || pattern FROM rules),
        hosts AS (SELECT *, regexp_replace(lower(regexp_extract(u, '{_HOST}', 1)), '\.+$', '') AS host,
                         regexp_extract(u, '{_REST}', 1) AS rest FROM parts),
        keys AS (SELECT *, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ',' ||
                        CASE WHEN is_rule = 1 OR starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS key FROM hosts),
        hit AS (SELECT p.id, p.url, p.key, count(r.id) AS n_rules, arg_max(r.id, length(r.key)) AS rule_id
                FROM keys p LEFT JOIN keys r ON r.is_rule = 1 AND starts_with(p.key, r.key) WHERE p.is_rule = 0 GROUP BY ALL)
        SELECT h.id AS page_id, h.url, h.rule_id, coalesce(rules.action, 'allow') AS action, h.n_rules FROM hit h LEFT JOIN rules USING (rule_id)"""
}

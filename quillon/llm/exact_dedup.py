"""Exact deduplication by progressive refinement.

Documents are grouped by length, the groups that hold more than one by a hash
of the first bytes, and only what survives both is read in full and hashed.
Lengths and prefix hashes come from one scan, 24 bytes a document, as a column
store reads the text for either.  Groups are counted by aggregates that combine
before the shuffle, so one of any number of copies is no row and no task of its
own.  What a SHA-256 cannot tell apart counts as equal.

Defined results: a NULL text equals nothing and is kept; empty texts equal each
other; the smallest doc_id of a group is kept (a NULL doc_id is never removed
and never chosen over a number); repeated rows of one doc_id and text count as
one document and one of them is kept; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX_CHARS = 256
_KEY = ["__len", "__head"]


def _head():
    return F.xxhash64(F.substring("text", 1, PREFIX_CHARS))


def survivors(docs: DataFrame) -> DataFrame:
    """__len and __head that several rows share: first the lengths of more than one, then with these the prefix hashes."""
    known = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keys = common.cut(known.select(F.octet_length("text").alias("__len"), _head().alias("__head")))
    sizes = common.cut(keys.groupBy("__len").agg(F.count("*").alias("n")).where("n > 1").select("__len"))
    heads = keys.join(common.sized(sizes), "__len", "left_semi").groupBy(*_KEY).agg(F.count("*").alias("n"))
    return common.cut(heads.where("n > 1").select(*_KEY))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, __len, __head, __full, n_rows, keep_id, n_copies of each text that is in several rows.

    Only the texts of surviving documents are read in full, unless their keys
    are too many to broadcast: then hashing all texts where they are is less
    than moving them.
    """
    keys = survivors(docs)
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.octet_length("text").alias("__len"), _head().alias("__head"))
    hashed = ("doc_id", *_KEY, F.sha2("text", 256).alias("__full"))
    few = keys.count() <= common.BROADCAST_ROWS
    rows = rows.join(F.broadcast(keys), _KEY, "left_semi").select(*hashed) if few else rows.select(*hashed).join(keys, _KEY, "left_semi")
    rows = common.cut(rows.groupBy("doc_id", *_KEY, "__full").agg(F.count("*").alias("n_rows")))
    same = rows.groupBy("__len", "__full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies"), F.max("n_rows").alias("most"))
    same = common.cut(same.where("n_copies > 1 OR most > 1").drop("most"))
    return rows.join(common.sized(same), ["__len", "__full"]).where("n_copies > 1 OR n_rows > 1")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, n_copies for every document whose text occurs in more than one.

    keep_id is the smallest doc_id with that text.  Unique documents are absent.
    """
    return copies(docs).where("n_copies > 1").select("doc_id", "keep_id", "n_copies")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with one of each text, in the columns of ``docs``."""
    cols = docs.columns
    size, head, full = (common.fresh(cols, k) for k in ("len", "head", "full"))
    found = common.cut(copies(docs).withColumnsRenamed({"__len": size, "__head": head, "__full": full}))
    on = ["doc_id", size, head]
    tagged = docs.withColumns({size: F.octet_length("text"), head: _head()})
    lost = common.cut(found.where("doc_id <> keep_id").groupBy(*on).agg(F.collect_set(full).alias(full)))
    # The full hash of a row is taken only where the cheap keys are those of a copy.
    kept = tagged.join(common.sized(lost), on, "left").where(F.col(full).isNull() | ~F.array_contains(full, F.sha2("text", 256))).drop(full)
    again = common.cut(found.where("doc_id = keep_id AND n_rows > 1").select(*on).distinct())
    if not again.isEmpty():  # one row of each document that is in the table more than once
        ids = common.sized(again)
        kept = kept.join(ids, on, "left_anti").unionByName(kept.join(ids, on, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*[F.col(f"`{c}`") for c in cols])


def op6_exact_dedup(spark, sf_dir):
    """Every document of ``documents`` that has an exact copy, with the one to keep."""
    return groups(common.read(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
        WITH g AS (SELECT text, min(doc_id) AS keep_id, count(DISTINCT doc_id) AS n_copies
                   FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id) > 1)
        SELECT DISTINCT d.doc_id, g.keep_id, g.n_copies FROM documents d JOIN g USING (text)"""
}

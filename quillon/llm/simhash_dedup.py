"""Near-duplicates by SimHash fingerprints in vantage-point trees.

A fingerprint is 64 SimHash bits over the distinct words of a document, each
weighing by its bytes and the logarithm of its occurrences.  Two documents are
a pair if the Hamming distance of these is at most RADIUS and the SimHashes of
their word pairs, an independent check, differ in at most CONFIRM bits.  Both
are exact conditions; the trees only decide what is compared.  Length is no
part of either, so that a copy with text appended or cut off is judged by the
words it shares.

The upper tree is built from a bounded sample of fingerprints (the sample
moves borders, never results) and cuts the space into shards.  A fingerprint
lives in one shard and is also a query in each shard that its ball overlaps by
the triangle inequality; of two shards that may hold a pair one is asked
(``asks``).  Each shard builds its own tree and joins all its queries at once,
splitting them at each node that prunes.  A shard's queries come in parts of
PART, each with all points of the shard.  Of the pairs found a part returns a
spanning forest, which has the same connected components.

What the bounds can do: distances of unrelated texts lie around 32 with a
deviation of 4, so of a median border about 1.6 RADIUS / 8 of the points are on
both sides, which is nearly all from a radius of 5 on.  Below that the trees
prune but near copies are lost (the README has the figures); at RADIUS shards
are therefore few and large, and comparisons grow with the square of the
distinct fingerprints, 24 bytes of which are shuffled per shard visited.

Equal fingerprints are collapsed first by partial aggregates, so copies cost
nothing and a group of any number of them is never in one task.

Defined results: a document with no word (NULL, empty, blank) has no near
duplicate; the smallest doc_id of a group is kept; rows with NULL doc_id are
kept and never match; repeated rows of one doc_id are one document, whose
fingerprint is the smallest of theirs, and stay or go together; extra columns
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 12
CONFIRM = 18
#: Distinct fingerprints that a shard holds on average: 24 MB of them.
SHARD = 1_000_000
#: Queries that a shard joins at once, on average.
PART = 500_000
#: Fingerprints from which the upper tree's borders are taken.
SAMPLE = 16_384
LEAF = 192
#: Bytes of a word that count, and the units of its weight.
LONG = 12
UNIT = 4
#: Pairs compared at a time.
_BLOCK = 1 << 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _simhash(own: np.ndarray, h: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """64-bit SimHash of each of n rows from the hashes h of its features (own sorted): bit k is 1 where the features with bit k outweigh the others."""
    out = np.zeros(n, np.uint64)
    for lo in range(0, n, 256):  # rows at a time, as each feature takes 64 numbers
        a, b = np.searchsorted(own, [lo, lo + 256])
        if a < b:
            rows, start = np.unique(own[a:b], return_index=True)
            bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1)
            if weight is None:
                all_ = np.diff(np.append(start, b - a))
                ones = np.add.reduceat(bits, start, axis=0, dtype=np.int64)
            else:
                all_ = np.add.reduceat(weight[a:b], start, dtype=np.int64)
                ones = np.add.reduceat(bits * weight[a:b, None], start, axis=0, dtype=np.int64)
            out[rows] = np.packbits(2 * ones > all_[:, None], axis=1).view(np.uint64).ravel()
    return out


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, SimHash of the weighted distinct words, SimHash of word pairs."""
    raw, at = common.text_bytes(texts)
    start, end, first, h = common.words(raw, at, _FOLD)
    n, own, count = len(at) - 1, common.owner(first), np.diff(first)
    order = np.lexsort((h, own))
    o, x, size = own[order], h[order], (end - start)[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    at_ = np.flatnonzero(new)
    times = np.diff(np.append(at_, len(o)))
    weight = np.rint(UNIT * np.minimum(size[at_], LONG) * (1 + np.log(np.maximum(times, 1)))).astype(np.uint16)
    a = _simhash(o[at_], x[at_], weight, n)
    two = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
    single = np.flatnonzero(count[own] == 1)  # a document of one word has that as its only pair
    pair = common.mix(h[two] * np.uint64(0x9E3779B97F4A7C15) + h[two + 1]) if len(two) else np.zeros(0, np.uint64)
    po, ph = np.concatenate([own[two], own[single]]), np.concatenate([pair, h[single]])
    order = np.argsort(po, kind="stable")
    return count, a, _simhash(po[order], ph[order], None, n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a, b of each document that has a word."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for c in common.chunks(batches, "text"):
            count, a, b = fingerprint(c.column(1))
            keep = count > 0
            yield pa.RecordBatch.from_arrays([c.column(0).filter(pa.array(keep)), pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["doc_id", "a", "b"])

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, a long, b long")


def distance(a: np.ndarray, b) -> np.ndarray:
    """Hamming distance of fingerprints."""
    return np.bitwise_count(a ^ b).astype(np.int32)


def _vantage(a: np.ndarray, own: np.ndarray, radius: int, rng, tries: int) -> tuple[float, int, int]:
    """Of a few points the one whose median border has the smallest share of the others within the radius: share, point, border."""
    some = own[rng.integers(0, len(own), 512)] if len(own) > 512 else own
    best = None
    for v in rng.choice(own, min(tries, len(own)), replace=False):
        d = distance(a[some], a[v])
        mu = int(np.median(d))
        both = float(np.mean((d - radius <= mu) & (d + radius > mu))) - 1e-6 * float(d.std())
        if best is None or both < best[0]:
            best = both, int(v), mu
    return best


def upper_tree(a: np.ndarray, depth: int, radius: int = RADIUS) -> list[tuple[np.uint64, int]]:
    """Vantage points and borders of a complete tree, in heap order."""
    nodes: list = [(np.uint64(0), 0)] * (2**depth - 1)
    todo = [(0, np.arange(len(a)))]
    rng = np.random.default_rng(11)
    while todo:
        at, own = todo.pop()
        if at >= len(nodes) or not len(own):
            continue
        _, v, _ = _vantage(a, own, radius, rng, 8)
        d = distance(a[own], a[v])
        mu = int(np.median(d))
        nodes[at] = (a[v], mu)
        todo += [(2 * at + 1, own[d <= mu]), (2 * at + 2, own[d > mu])]
    return nodes


def route(nodes: list, depth: int, a: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each fingerprint, a shard that its ball overlaps, and whether that is its home."""
    idx, at, home = np.arange(len(a)), np.zeros(len(a), np.int64), np.ones(len(a), bool)
    va, mu = np.array([x for x, _ in nodes], np.uint64), np.array([m for _, m in nodes], np.int64)
    for _ in range(depth):
        d, m = distance(a[idx], va[at]), mu[at]
        inner, left, right = d <= m, d - radius <= m, d + radius > m
        idx, home, at = np.concatenate([idx[left], idx[right]]), np.concatenate([(home & inner)[left], (home & ~inner)[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    return idx, at - (2**depth - 1), home


def asks(home: np.ndarray, shard: np.ndarray, n: int) -> np.ndarray:
    """Whether a fingerprint of the shard ``home`` is a query in ``shard``, of n: of two shards one asks the other, each as many as any."""
    ahead = 2 * ((shard - home) % n)
    return (ahead < n) | (ahead == n) & (shard > home)


def tree_join(points: np.ndarray, queries: np.ndarray, radius: int = RADIUS, seed: int = 0):
    """Yields arrays of all (query, point) index pairs within the radius, by one batched walk of a vantage-point tree."""
    rng = np.random.default_rng(seed)
    xor, bits = np.empty(_BLOCK, np.uint64), np.empty(_BLOCK, np.uint8)
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            both, v, mu = _vantage(points, p, radius, rng, 4)
            if both < 0.9:  # a border that prunes less costs more than it saves
                d, e = distance(points[p], points[v]), distance(queries[q], points[v])
                if 0 < int((d <= mu).sum()) < len(p):
                    todo += [(p[d <= mu], q[e - radius <= mu]), (p[d > mu], q[e + radius > mu])]
                    continue
        for left in range(0, len(p), _BLOCK):  # what is left is compared in blocks that fit the cache
            block = p[left : left + _BLOCK]
            some, step = points[block], max(1, _BLOCK // len(block))
            for lo in range(0, len(q), step):
                part = q[lo : lo + step]
                n = len(part) * len(block)
                np.bitwise_xor(queries[part][:, None], some[None, :], out=xor[:n].reshape(len(part), len(block)))
                i, j = np.divmod(np.flatnonzero(np.bitwise_count(xor[:n], out=bits[:n]) <= radius), len(block))
                if len(i):
                    yield part[i], block[j]


class Forest:
    """Connected components of n items as pairs arrive; an item's root has the smallest key of its component."""

    def __init__(self, key: np.ndarray):
        self.order = np.argsort(key, kind="stable")  # items by rank of their key
        self.rank = np.empty(len(key), np.int64)
        self.rank[self.order] = np.arange(len(key))
        self.root = np.arange(len(key))  # over ranks

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins the items x[k] and y[k]."""
        u, v = self.rank[x], self.rank[y]
        while len(u):
            u, v = self.find(u), self.find(v)
            apart = u != v
            u, v = u[apart], v[apart]
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))

    def find(self, u: np.ndarray) -> np.ndarray:
        """Roots of ranks, shortening the ways to them."""
        r = self.root[u]
        while len(u):
            up = self.root[r]
            if np.array_equal(up, r):
                break
            r = up
        self.root[u] = r
        return r

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each item that is no root, and its root."""
        ranks = np.arange(len(self.root))
        r = self.find(ranks)
        far = np.flatnonzero(r != ranks)
        return self.order[far], self.order[r[far]]


def components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) for the ids in ``edges`` (x, y).

    Rounds of large-star and small-star contraction by minima and joins, each
    cut to the shared folder, so that no list of a hub's neighbours is ever
    made; their number grows with the logarithm of the diameter.
    """
    edges = common.cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state


def links(points: DataFrame, n: int) -> DataFrame:
    """Edges x, y of which the components are the near-duplicate groups of ``points`` (id, a, b; n rows, distinct fingerprints)."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))), min(4, int(np.log2(max(1, n // 256)))))
    parts = max(1, -(-n // PART))
    some = common.hash_sample(points.select("a"), SAMPLE, "a", n=n).toPandas()["a"].to_numpy(np.int64).view(np.uint64)
    nodes = upper_tree(some, depth)

    def visit(batches):
        for c in batches:
            a, ids = c.column("a").to_numpy().view(np.uint64), c.column("id").to_numpy()
            idx, shard, home = route(nodes, depth, a)
            own = np.zeros(len(a), np.int64)
            own[idx[home]] = shard[home]
            use = asks(own[idx], shard, 2**depth)
            idx, shard = idx[use], shard[use]
            part = (common.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            # A query goes to its part of each shard that it asks, a point to all parts of its own.
            everywhere = np.repeat(np.arange(len(a)), parts)
            at = np.concatenate([shard * parts + part[idx], own[everywhere] * parts + np.tile(np.arange(parts), len(a))])
            point = np.arange(len(at)) >= len(idx)
            rows = pa.array(np.concatenate([idx, everywhere]))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(point), *[c.column(k).take(rows) for k in ("id", "a", "b")]], ["shard", "point", "id", "a", "b"])

    def join(t: pa.Table) -> pa.Table:
        ids, point = t.column("id").to_numpy(), t.column("point").to_numpy()
        a, b = (t.column(k).to_numpy().view(np.uint64) for k in "ab")
        p, q = np.flatnonzero(point), np.flatnonzero(~point)
        found = Forest(ids)
        for x, y in tree_join(a[p], a[q]):
            x, y = q[x], p[y]
            ok = (ids[x] != ids[y]) & (np.bitwise_count(b[x] ^ b[y]) <= CONFIRM)
            found.add(x[ok], y[ok])
        u, v = (ids[x] for x in found.edges())
        apart = u != v  # a fingerprint is both a query and a point
        return pa.table({"x": pa.array(u[apart], pa.int64()), "y": pa.array(v[apart], pa.int64())})

    spread = points.mapInArrow(visit, "shard long, point boolean, id long, a long, b long")
    return spread.groupBy("shard").applyInArrow(join, "x long, y long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, n_near for every document in a group of near-duplicates, exact copies included."""
    one = common.cut(fingerprints(docs).groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("f")).select("doc_id", "f.*"))
    points = common.cut(one.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    roots = components(links(points.select("id", "a", "b"), points.count()))
    points = points.join(roots, "id", "left").withColumn("keep_id", F.coalesce("root", "id"))
    near = points.groupBy("keep_id").agg(F.sum("n").alias("n_near")).where("n_near > 1")
    found = common.cut(points.join(near, "keep_id").select("a", "b", "keep_id", "n_near"))
    return one.join(common.sized(found), ["a", "b"]).select("doc_id", "keep_id", "n_near")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with one of each group, in the columns of ``docs``."""
    lost = common.cut(groups(docs).where("doc_id <> keep_id").select("doc_id"))
    return docs.join(common.sized(lost), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_near_dedup(spark, sf_dir):
    """Every document of ``documents`` in a group of near-duplicates, with the one to keep."""
    return groups(common.read(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLES: dict[str, str] = {}

"""Nearest neighbours of query vectors among all vectors by a block matrix join.

All vectors are quantised to int8 with a scale each and hashed into blocks of
bounded size, the queries too; each pair of blocks is a tile.  Only codes,
scales and errors are shuffled to tiles.  Products of the codes over EXACT
dimensions are whole numbers below 2^24, so a float32 matrix product gives them
exactly.  If a vector lies e from its quantised form, a distance lies within
e_x + e_y of the quantised one: pairs whose lower bound exceeds the k-th
smallest upper bound of a query cannot be among its neighbours and go, first
in the tile, then by the least bound of all tiles.  For the rest the floats are
fetched, distances computed in double precision, and the sorted lists of a
query merged through a heap.  The result is exact.

Defined results: vectors that are NULL, empty or hold NULL, NaN or infinite
values are left out; vectors meet only those of their own length; rows of one
vec_id count once, with their smallest vector; ties go to the smaller
vec_id; with fewer than k others all are returned; a query is no neighbour of
itself; extra columns are not read.
"""

from __future__ import annotations

from heapq import merge
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 10
#: Vectors of a block, and the rows and columns of a matrix product.
BLOCK = 1 << 17
STEP = 4096
#: Rows whose id is divisible by this are the queries of the registered query.
EVERY = 100
#: Dimensions of which a sum of products of int8 codes stays below 2^24.
EXACT = 1024


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the distance of each vector from its quantised form."""
    scale = np.abs(v).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(v - codes * scale[:, None], axis=1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, whole numbers: float32 holds those of EXACT dimensions, wider ones are summed in float64."""
    if x.shape[1] <= EXACT:
        return x @ y.T
    return sum((x[:, k : k + EXACT] @ y[:, k : k + EXACT].T).astype(np.float64) for k in range(0, x.shape[1], EXACT))


class Codes:
    """Vectors of a block: ids, int8 codes, scales, errors, squared norms of the quantised forms."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray):
        self.ids, self.codes, self.scale, self.error = ids, codes, scale, error
        self.norm = np.einsum("ij,ij->i", codes, codes, dtype=np.int64) * scale**2


def bounds(q: Codes, base: Codes, k: int):
    """Yields (query index, base index, lower bound, upper bound) of the pairs of the tile that may be among a query's k nearest."""
    for lo in range(0, len(q.ids), 1024):
        rows = slice(lo, lo + 1024)
        x = q.codes[rows].astype(np.float32)
        kth = np.full(len(x), np.inf)  # k-th smallest upper bound so far
        upper = np.full((len(x), k), np.inf)
        held = []
        for at in range(0, len(base.ids), STEP):
            cols = slice(at, at + STEP)
            d2 = q.norm[rows, None] + base.norm[None, cols] - 2 * q.scale[rows, None] * base.scale[None, cols] * _products(x, base.codes[cols].astype(np.float32))
            # Double precision in all but the product, which is exact; what rounding is left is far below 1e-6 of the norms.
            slack = q.error[rows, None] + base.error[None, cols] + 1e-7 * np.sqrt(q.norm[rows, None] + base.norm[None, cols]) + 1e-12
            d = np.sqrt(np.maximum(d2, 0))
            d[q.ids[rows, None] == base.ids[None, cols]] = np.inf
            high = d + slack
            if high.shape[1] > k:
                high = np.partition(high, k - 1, axis=1)[:, :k]
            upper = np.sort(np.concatenate([upper, high], 1), axis=1)[:, :k]
            kth = upper[:, k - 1]
            i, j = np.nonzero((d - slack <= kth[:, None]) & np.isfinite(d))
            held.append((i, j + at, (d - slack)[i, j], (d + slack)[i, j]))
        if held:
            i, j, low, high = (np.concatenate(z) for z in zip(*held))
            ok = low <= kth[i]
            yield i[ok] + lo, j[ok], low[ok], high[ok]


def nearest(vectors: DataFrame, k: int = K, block: int = BLOCK, every: int = 1) -> DataFrame:
    """vec_id, rank, neighbour_id, distance of the k nearest others, by Euclidean distance, of each vector whose vec_id ``every`` divides."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id IS NOT NULL").where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    one = common.cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")))

    def encode(batches):
        for b in batches:
            flat, off = b.column(1).flatten().to_numpy(zero_copy_only=False), np.asarray(b.column(1).offsets).astype(np.int64)
            off = off - off[0]
            size = np.diff(off)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                for lo in range(0, len(rows), 8192):
                    some = rows[lo : lo + 8192]
                    codes, scale, error = quantise(flat[off[some][:, None] + np.arange(dim)])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(np.full(len(some), dim, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], ["vec_id", "dim", "codes", "scale", "error"])

    coded = common.cut(one.mapInArrow(encode, "vec_id long, dim int, codes binary, scale double, error double"))
    query = F.col("vec_id") % every == 0
    n = coded.agg(F.count("*").alias("all"), F.coalesce(F.sum(query.cast("long")), F.lit(0)).alias("asked")).first()
    # A tile for each pair of blocks; blocks also small enough that all cores have one.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-n.all // block), min(cores, n.all // STEP))
    down = max(1, -(-n.asked // block))
    h = F.xxhash64("vec_id")
    points = coded.withColumns({"j": F.pmod(h, F.lit(across)), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))), "asks": F.lit(False)})
    queries = coded.where(query).withColumns({"i": F.pmod(h, F.lit(down)), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))), "asks": F.lit(True)})

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        dim = t.column("dim")[0].as_py()
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(-1, dim)
        ids, scale, error = (t.column(c).to_numpy() for c in ("vec_id", "scale", "error"))
        q, base = (Codes(ids[m], codes[m], scale[m], error[m]) for m in (asks, ~asks))
        found = [(q.ids[i], base.ids[j], low, high) for i, j, low, high in bounds(q, base, k)] if len(q.ids) and len(base.ids) else []
        cols = [np.concatenate(z) for z in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table({name: pa.array(x) for name, x in zip(("vec_id", "neighbour_id", "low", "high"), cols)})

    tiles = points.unionByName(queries).groupBy("dim", "i", "j").applyInArrow(run, "vec_id long, neighbour_id long, low double, high double")
    pairs = common.cut(tiles)
    # The k-th upper bound of all tiles: each tile sent at least its k best.
    top = F.array_sort(F.collect_list("high"))
    kth = pairs.groupBy("vec_id").agg(F.when(F.size(top) >= k, top[k - 1]).otherwise(float("inf")).alias("kth"))
    left = common.cut(pairs.join(kth, "vec_id").where("low <= kth").select("vec_id", "neighbour_id"))
    floats = left.join(one.select(F.col("vec_id").alias("neighbour_id"), F.col("v").alias("y")), "neighbour_id").join(one.select("vec_id", F.col("v").alias("x")), "vec_id").select("vec_id", "neighbour_id", "x", "y")

    def measure(batches):
        for b in batches:
            x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            off = np.asarray(b.column(2).offsets).astype(np.int64)
            d = np.sqrt(np.add.reduceat((x - y) ** 2, off[:-1] - off[0])) if len(b) else np.zeros(0)
            q, nb = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((nb, d, q))
            q, nb, d = q[order], nb[order], d[order]
            first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, np.int64)
            cuts = pa.array(np.append(first, len(q)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(q[first]), pa.ListArray.from_arrays(cuts, pa.array(nb)), pa.ListArray.from_arrays(cuts, pa.array(d))], ["vec_id", "ids", "ds"])

    def heaps(batches):
        for b in batches:
            q, r, nb, ds = [], [], [], []
            for v, ids, dist in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                best = list(islice(merge(*[zip(d, i) for i, d in zip(ids, dist)]), k))
                q += [v] * len(best)
                r += range(1, len(best) + 1)
                nb += [i for _, i in best]
                ds += [d for d, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(nb, pa.int64()), pa.array(ds, pa.float64())], ["vec_id", "rank", "neighbour_id", "distance"])

    lists = floats.mapInArrow(measure, "vec_id long, ids array<long>, ds array<double>")
    merged = lists.groupBy("vec_id").agg(F.collect_list("ids").alias("ids"), F.collect_list("ds").alias("ds"))
    return merged.mapInArrow(heaps, "vec_id long, rank int, neighbour_id long, distance double").withColumn("distance", F.round("distance", 6))


def op2_nearest_neighbours(spark, sf_dir):
    """The ten nearest neighbours of every vector of ``embeddings`` whose id 100 divides, among all."""
    return nearest(common.read(spark, sf_dir, "embeddings"), every=EVERY)


QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours}
ORACLES = {
    "op2_nearest_neighbours": f"""
        WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
                   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d)
        SELECT vec_id, rank::INT AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}"""
}

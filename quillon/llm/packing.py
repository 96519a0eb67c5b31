"""Best-fit packing of documents into sequences, improved by swaps.

Documents are cut into pieces of at most CAPACITY tokens (words).  Hash shards
of bounded size are packed side by side: best-fit decreasing fills the bins,
then a local search takes the emptiest bin and moves its pieces into other
underfull bins, alone, one against one or two against one, whichever fills the
receiver most.  As the receiver is at least as full as the donor each step
raises the sum of squared fills, so the search ends; donors that empty are
dropped.  Pieces of receivers are indexed by what may be sent to their bin in
exchange for them, so a step looks at CAPACITY numbers, not at all bins.  Only
ids and lengths are shuffled, never texts; equal rows are counted before and
spread over the shards.

Defined results: a document without words (NULL or empty text) takes no room
and gets a row with NULL bin; a document longer than a bin gives full pieces
and a rest, its bins dedicated to it until the rest is packed; repeated rows
are packed each; NULL doc_id is an ordinary value; extra columns are not read;
an empty table gives no rows; ties between moves go to the larger room, between
pieces to the earlier one.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Documents of a shard on average; the number of shards grows with the table.
SHARD = 20_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins, each a list of indices of ``sizes``, by best-fit decreasing; free space is looked up in a bit set."""
    free_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        above = mask >> s
        if above:
            f = s + (above & -above).bit_length() - 1
            b = free_at[f].pop()
            if not free_at[f]:
                mask &= ~(1 << f)
        else:
            f, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if f > s:
            free_at[f - s].append(b)
            mask |= 1 << (f - s)
    return bins


class Receivers:
    """The pieces that may leave underfull bins, by the most that may be sent to the bin for them.

    A piece of size s in a bin with room r stands under s + r, and the room
    itself as a piece of size 0.  ``least[t]`` is the smallest size under t,
    which gains most.  A heap's entry counts only while its bin has the room
    and the piece that it names.
    """

    def __init__(self, capacity: int):
        self.none = capacity + 1
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, self.none, np.int64)

    def add(self, b: int, room: int, pieces: list[int], sizes: list[int]) -> None:
        """Enters the bin's room and pieces."""
        for s, i in [(0, -1), *((sizes[i], i) for i in pieces)]:
            t = s + room
            heappush(self.heaps[t], (s, b, i))
            if s < self.least[t]:
                self.least[t] = s

    def top(self, t: int, valid) -> tuple[int, int, int] | None:
        """The first entry under t that is still valid; ``least`` follows."""
        heap = self.heaps[t]
        while heap and not valid(t, *heap[0]):
            heappop(heap)
        self.least[t] = heap[0][0] if heap else self.none
        return heap[0] if heap else None


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins after exchanges between underfull ones; never more bins, never one overfull.

    Passes over the donors, emptiest first, go on while one of them moves a
    piece; each move adds to the sum of squared fills, so they end.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    at = {i: b for b, pieces in enumerate(bins) for i in pieces}
    moved = True
    while moved:
        moved = False
        donors = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (fill[b], b))
        place = Receivers(capacity)
        ahead = set(donors)  # bins after the present donor: at least as full as it is
        for b in donors:
            place.add(b, capacity - fill[b], bins[b], sizes)

        def valid(t: int, s: int, b: int, i: int) -> bool:
            return b in ahead and fill[b] < capacity and s + capacity - fill[b] == t and (i < 0 or at[i] == b)

        for d in donors:
            ahead.discard(d)
            while bins[d] and ahead:
                own = sorted((sizes[i], i) for i in bins[d])
                give = {s: (i,) for s, i in reversed(own)}
                for k, (s, i) in enumerate(own):
                    for r, j in own[k + 1 :]:
                        if s + r <= capacity:
                            give.setdefault(s + r, (i, j))
                amounts = sorted(give)
                # The most that can be sent for each t, and what it gains against the smallest piece there
                most = np.array([0, *amounts])[np.searchsorted(amounts, np.arange(capacity + 1), "right")]
                best = None
                while True:
                    gain = most - place.least
                    t = len(gain) - 1 - int(gain[::-1].argmax())
                    if gain[t] <= 0:
                        break
                    stale = place.least[t]
                    best = place.top(t, valid)
                    if best is not None and best[0] == stale:
                        break
                    best = None
                if best is None:
                    break
                s, b, i = best
                sent = give[amounts[bisect_right(amounts, t) - 1]]
                bins[d] = [x for x in bins[d] if x not in sent]
                if i >= 0:
                    bins[b].remove(i)
                    bins[d].append(i)
                    at[i] = d
                bins[b] += sent
                at.update((x, b) for x in sent)
                fill[b] += int(gain[t])
                fill[d] -= int(gain[t])
                moved = True
                if fill[b] < capacity:
                    place.add(b, capacity - fill[b], bins[b], sizes)
    return [b for b in bins if b]


def _each(counted: DataFrame, step: int = 4096) -> DataFrame:
    """doc_id, tokens, copy from 1 to n for each counted row; in two steps, so that no array is longer than the root of n or ``step``."""
    some = counted.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    return some.select("doc_id", "tokens", F.explode(F.sequence(F.col("lo") + 1, F.least(F.col("n"), F.col("lo") + step))).alias("copy"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start_token, tokens, bin_id, bin_fill for each piece of each document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.n_words().alias("tokens"))
    n = common.cut(sized.groupBy("doc_id", "tokens").agg(F.count("*").alias("n")))
    full = n.where("tokens > 0")
    shards = max(1, -(-(full.agg(F.sum("n")).first()[0] or 0) // shard))

    def run(t: pa.Table) -> pa.Table:
        ids, tokens, key = t.column("doc_id").to_pylist(), t.column("tokens").to_pylist(), t.column("shard")[0].as_py()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, tokens[i]))
        pieces = [(i, s, min(capacity, tokens[i] - s)) for i in order for s in range(0, tokens[i], capacity)]
        part = [k for k, p in enumerate(pieces) if p[2] < capacity]
        sizes = [pieces[k][2] for k in part]
        bins = [[k] for k, p in enumerate(pieces) if p[2] == capacity] + [[part[i] for i in b] for b in improve(best_fit(sizes, capacity), sizes, capacity)]
        rows = [(ids[pieces[k][0]], pieces[k][1] // capacity, pieces[k][1], pieces[k][2], f"{key}-{n}", sum(pieces[j][2] for j in b)) for n, b in enumerate(bins) for k in b]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.table({k: pa.array(x, kind) for k, x, kind in zip(("doc_id", "piece", "start_token", "tokens", "bin_id", "bin_fill"), zip(*rows), kinds)})

    # The copies of a repeated row are spread too; a row of no words needs no bin.
    each = _each(full)
    keyed = each.select("doc_id", "tokens", F.pmod(F.when(F.col("copy") == 1, F.xxhash64("doc_id", "tokens")).otherwise(F.xxhash64("doc_id", "tokens", "copy")), F.lit(shards)).alias("shard"))
    packed = keyed.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start_token long, tokens long, bin_id string, bin_fill long")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    empty = _each(n.where("tokens = 0")).select("doc_id", zero.alias("piece"), zero.alias("start_token"), zero.alias("tokens"), none.cast("string").alias("bin_id"), none.cast("long").alias("bin_fill"))
    return packed.unionByName(empty)


def op4_best_fit_packing(spark, sf_dir):
    """The bins of all documents of ``documents``."""
    return pack(common.read(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}

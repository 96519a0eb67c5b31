"""Passages that repeat across documents, by suffix arrays of content shards.

A position is reported if the WORDS words from it also occur in another
document.  Suffix arrays must see equal passages side by side, so the corpus is
cut by content: a window of WORDS words belongs to the shard of the least hash
of its GRAM-word parts (its minimiser), which equal windows share wherever
they stand.  Consecutive windows with one minimiser form a segment; it carries
the words of all its windows, so each window is whole in exactly one shard.

Segments whose minimiser occurs in one document only hold no repeat and end
there.  Equal segments are collapsed to one by partial aggregates (their words
are compared by a hash modulo a prime); where a minimiser has several different
segments, their words go to a shard's suffix array, built by external induced
sorting (``induced_sort``) over word ids in two digits.  A shard streams into
files of its worker and is sorted there in blocks, so it may be far larger than
memory.  Runs of suffixes that share WORDS words or more and come from two
documents are repeats.

Defined results: NULL and short texts hold no repeat; words are what white
space separates, each compared by a 64-bit hash of its bytes; repeated rows of one doc_id are one
document and do not repeat each other; rows with NULL doc_id are not read;
extra columns neither; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .induced_sort import MEMORY, array, blocks, ranks, scratch, suffix_array

WORDS = 50
GRAM = 12
#: Words of a shard on average.
SHARD = 400_000
#: Words that are worth a shard of their own while executors would idle, and the most partitions that shards go to.
LEAST = 25_000
PARTITIONS = 8192


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    k, m = 1, h
    while 2 * k <= width:
        m = np.minimum(m[: len(m) - k], m[k:])
        k *= 2
    rest = width - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments_of(h: np.ndarray, first: np.ndarray, words: int = WORDS, gram: int = GRAM):
    """Row, first word in the row, number of windows, minimiser and content hash of each segment.

    h: word hashes of all rows, first: first word of each row (n+1).
    """
    n = len(h)
    own = common.owner(first)
    if n < words:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    at = np.arange(n - gram + 1)
    grams = common.mix(common.gram_hashes(h, at, at + gram) ^ np.uint64(0x5851F42D4C957F2D))
    least = window_min(grams, words - gram + 1)
    m = len(least)  # one for each window
    ok = own[:m] == own[words - 1 :]
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:m] != own[: m - 1]) | ~ok[:-1]
    new &= ok
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.bincount(run[ok], minlength=len(start))
    row = own[start]
    return row, start - first[row], size, least[start], common.span_hashes(h, start, start + size + words - 1)


def segments(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """key, doc_id, start, n, body for each segment: minimiser, place, windows, hash of its words."""

    def run(batches):
        for c in common.chunks(batches, "text"):
            raw, at = common.text_bytes(c.column(1))
            _, _, first, h = common.words(raw, at)
            row, start, n, key, body = segments_of(h, first, words, gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), c.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(body.view(np.int64))], ["key", "doc_id", "start", "n", "body"])

    return docs.mapInArrow(run, "key long, doc_id long, start int, n int, body long")


class Texts:
    """The texts of a shard in files: hashes of their words, and key, body, low, high and number of words of each."""

    def __init__(self):
        self.words, self.rows = (tempfile.TemporaryFile(dir=scratch()) for _ in range(2))

    def add(self, batch: pa.RecordBatch) -> None:
        """Adds the rows of a batch."""
        self.words.write(b"".join(batch.column("hashes").to_pylist()))
        size = np.asarray(pc.binary_length(batch.column("hashes"))) // 8
        self.rows.write(np.stack([*(batch.column(k).to_numpy() for k in ("key", "body", "low", "high")), size], 1).astype(np.int64).tobytes())

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes and rows (5 columns), mapped to memory."""
        out = []
        for f, kind, width in ((self.words, np.uint64, 1), (self.rows, np.int64, 5)):
            f.flush()
            n = f.tell() // 8
            x = np.memmap(f, kind, "r", shape=(n,)) if n else np.zeros(0, kind)
            out.append(x.reshape(-1, 5) if width == 5 else x)
        return out[0], out[1]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """The texts of each shard from batches in order of shards, one shard at a time."""
    held, at = None, None
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if lo == hi:
                continue
            if held is not None and shard[lo] != at:
                yield held
                held = None
            held, at = held or Texts(), shard[lo]
            held.add(b.slice(lo, hi - lo))
    if held is not None:
        yield held


def repeated_windows(texts: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, words: int = WORDS, memory: int = MEMORY):
    """Yields text, first and last window of runs of windows that texts of different documents share.

    texts: the word hashes of all texts, one after the other; size: words of
    each; low, high: least and greatest doc_id that a text occurs in.
    """
    n, m = len(texts), len(size)
    ids, top = ranks(n, lambda items, level: (texts[items], np.zeros(len(items), bool)), memory)
    radix = int(np.ceil(np.sqrt(top)))
    start = array(m, np.int64, memory)  # first word of each text
    for lo, hi in blocks(m, memory):
        start[lo:hi] = np.cumsum(size[lo:hi]) - size[lo:hi] + (start[lo - 1] + size[lo - 1] if lo else 0)
    text = array(2 * n + m, np.int32, memory)
    for lo, hi in blocks(n, memory):
        w = np.arange(lo, hi)
        place = 2 * w + np.searchsorted(start, w, "right") - 1
        text[place], text[place + 1] = ids[lo:hi] // radix + 1, ids[lo:hi] % radix + 1
    del ids
    begin = array(m, np.int64, memory)  # first symbol of each text
    for lo, hi in blocks(m, memory):
        begin[lo:hi] = 2 * start[lo:hi] + np.arange(lo, hi)
    sa, lcp = suffix_array(text, radix + 1, memory)

    def runs():
        """Blocks of suffixes that begin a window: their run, word and text."""
        run = -1
        for lo, hi in blocks(len(sa), memory):
            p, r = np.asarray(sa[lo:hi]), run + np.cumsum(np.asarray(lcp[lo:hi]) < 2 * words)
            run = int(r[-1])
            own = np.searchsorted(begin, p, "right") - 1
            at = p - begin[own]
            ok = (at % 2 == 0) & (at // 2 <= size[own] - words)
            yield r[ok], (start[own] + at // 2)[ok], own[ok]

    lcp[0] = 0
    count = sum(int(np.count_nonzero(lcp[lo:hi] < 2 * words)) for lo, hi in blocks(len(sa), memory))
    several = array(count, bool, memory)
    last = (-1, 0, 0)  # a run that may go on in the next block, its least and greatest document
    for r, _, own in runs():
        if len(r):
            at = np.flatnonzero(np.diff(r, prepend=-1))
            least, most, ids = np.minimum.reduceat(low[own], at), np.maximum.reduceat(high[own], at), r[at]
            if ids[0] == last[0]:
                least[0], most[0] = min(least[0], last[1]), max(most[0], last[2])
            several[ids] |= least < most
            last = (int(ids[-1]), int(least[-1]), int(most[-1]))
    hit = array(n, bool, memory)
    for r, w, _ in runs():
        hit[w] = several[r]
    del sa, lcp
    for lo, hi in blocks(n, memory):  # a run over a border is two that touch
        w = np.flatnonzero(hit[lo:hi]) + lo
        if len(w):
            own = np.searchsorted(start, w, "right") - 1
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1] + 1) | (own[1:] != own[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(w)) - 1
            yield own[a], w[a] - start[own[a]], w[b] - start[own[a]]


def repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, start_word, end_word, n_words of each passage (end exclusive) made of windows that other documents hold too."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = segments(texts, words, gram)  # computed twice: cheaper than keeping all for the few that stay
    several = common.cut(found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"))
    shared = common.cut(found.join(common.sized(several), "key", "left_semi"))
    # Equal segments: one row, with the place of one of them
    bodies = shared.groupBy("key", "body").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by(F.struct("doc_id", "start"), F.struct("doc_id", "start")).alias("at"), F.first("n").alias("n"))
    bodies = common.cut(bodies)
    alike = bodies.where("low < high").select("key", "body", F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    unlike = common.cut(bodies.join(bodies.groupBy("key").agg(F.count("*").alias("others")).where("others > 1"), "key"))

    total = unlike.agg(F.coalesce(F.sum(F.col("n") + words - 1), F.lit(0)).alias("w")).first().w
    shards = max(1, -(-total // shard), min(-(-total // LEAST), 2 * spark.sparkContext.defaultParallelism))
    # A row for each document that an example is taken from: 40 bytes for each segment of its text
    wanted = common.cut(unlike.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "n", "key", "body", "low", "high")).alias("parts")))
    ids = common.sized(wanted.select("doc_id"))
    sources = texts.join(ids, "doc_id", "left_semi").join(wanted, "doc_id").select("doc_id", "text", "parts")

    def extract(batches):
        for b in batches:
            parts, flat = b.column(2), b.column(1)
            for i in range(len(b)):
                p = parts[i].values
                s, n, body = (p.field(k).to_numpy() for k in ("start", "n", "body"))
                raw, at = common.text_bytes(flat.slice(i, 1))
                _, _, _, h = common.words(raw, at)
                e = s + n + words - 1
                fits = np.flatnonzero(e <= len(h))
                # A doc_id may have several texts: the hash tells whether this is the one.
                fits = fits[common.span_hashes(h, s[fits], e[fits]).view(np.int64) == body[fits]]
                if len(fits):
                    take = pa.array(fits)
                    yield pa.RecordBatch.from_arrays([*(p.field(k).take(take) for k in ("key", "body", "low", "high")), pa.array([h[s[j] : e[j]].tobytes() for j in fits.tolist()], pa.binary())], ["key", "body", "low", "high", "hashes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_shard(batches):
            hashes, rows = held.read()
            for row, a, b in repeated_windows(hashes, rows[:, 4], rows[:, 2], rows[:, 3], words):
                yield pa.RecordBatch.from_arrays([pa.array(rows[row, 0]), pa.array(rows[row, 1]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["key", "body", "a", "b"])

    pieces = sources.mapInArrow(extract, "key long, body long, low long, high long, hashes binary")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    parts = min(shards, PARTITIONS)  # a shard to a partition: its bytes say little of its work, so none are merged
    partial = pieces.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard").mapInArrow(sort, "key long, body long, a int, b int")

    marks = common.cut(alike.unionByName(partial))
    spans = shared.join(marks, ["key", "body"]).select("doc_id", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).distinct()
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("a") > reach + words).cast("long"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "span").agg(F.min("a").cast("long").alias("start_word"), (F.max("b") + words).cast("long").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op3_suffix_dedup(spark, sf_dir):
    """Every passage of 50 words or more of ``documents`` that other documents hold too."""
    return repeats(common.read(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES = {
    "op3_suffix_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '{common.WORD_RE}') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(generate_series(0, len(ws) - {WORDS})) AS a, ws FROM w WHERE len(ws) >= {WORDS}),
        h AS (SELECT doc_id, a, md5(array_to_string(ws[a + 1 : a + {WORDS}], ' ')) AS h FROM p),
        r AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        s AS (SELECT DISTINCT doc_id, a FROM h SEMI JOIN r USING (h)),
        g AS (SELECT *, CASE WHEN a > lag(a) OVER (PARTITION BY doc_id ORDER BY a) + {WORDS} THEN 1 ELSE 0 END AS new FROM s),
        i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM g)
        SELECT doc_id, min(a) AS start_word, max(a) + {WORDS} AS end_word, max(a) + {WORDS} - min(a) AS n_words FROM i GROUP BY doc_id, span"""
}

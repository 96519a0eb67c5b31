"""Helpers the corpus operators share: reading, sized joins, vectorised words."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that may be broadcast (about 16 bytes each); above it a join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 20

#: White space of the word definition, the same in Java, RE2 and numpy.
WORD_RE = r"[^ \t\n\r\f]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: Sequences are hashed modulo this prime, for a base that texts cannot aim at as they could at a power of two.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_PRIME_BASE = 0x16A09E667F3BCC91 % PRIME
_PRIME_POWERS: list[np.ndarray] = []
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name in the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that all machines see: the session's ``spark.checkpoint.dir``.

    One of our own is set only where the session names none and runs on this
    machine alone, as in tests; a cluster without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized(ids: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most ``bound`` rows.

    Counting is cheap: callers pass a checkpointed frame.  Beyond the bound the
    join falls back to a shuffle, so no broadcast grows with the data.
    """
    return F.broadcast(ids) if ids.count() <= bound else ids


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def hash_sample(df: DataFrame, size: int, *key: str, n: int | None = None) -> DataFrame:
    """At most ``size`` rows in the order of a hash of ``key``.

    A first filter on the hash leaves about 1.5 ``size`` rows, so that no
    partition sends more to the driver than its part of them.
    """
    n = df.count() if n is None else n
    h = F.xxhash64(*key)
    if n > 2 * size:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(1.5 * size / n * (1 << 30)) + 1)
    return df.orderBy(h, *key).limit(size)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch, so that long texts fit a Python worker.

    Batches are made when a plan runs, so the setting stays in the session; it
    changes no batch of less than that size, and one that the caller set is left alone.
    """
    key, unset = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 2)
    if spark.conf.get(key, unset) == unset:
        spark.conf.set(key, str(size))


def n_words(text: str = "text"):
    """Column with the number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(size)
        lo, base = 0, 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            base, lo = ends[hi - 1], hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n+1 row offsets in them; NULL counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        p, q = np.full(m, _BASE, np.uint64), np.full(m, inv, np.uint64)
        p[0] = q[0] = 1
        _POWERS[:] = [np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the short spans ``symbols[start:end]``, by prefix sums modulo 2^64.

    Two sequences of 2048 symbols can be built that agree modulo any power of
    two; for spans of any length see ``span_hashes``.
    """
    n = len(symbols)
    p, q = _powers(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * p[:n], out=h[1:], dtype=np.uint64)
    return mix((h[end] - h[start]) * q[start] + (end - start).astype(np.uint64))


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def mul_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for a, b below it, by halves of 31 bits."""
    low, s = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> s, a & low, b >> s, b & low
    mid = a1 * b0 + a0 * b1  # below 2^62
    # 2^62 = 2 and 2^61 = 1: the middle part times 2^31 wraps at its 30th bit.
    return _reduce(a1 * b1 * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << s) + a0 * b0)


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _PRIME_POWERS or len(_PRIME_POWERS[0]) < n:
        m = max(n, 1 << 16)
        both = []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME)):
            x, k = np.ones(1, np.uint64), 1
            while k < m:
                x = np.concatenate([x, mul_mod(x, np.uint64(pow(base, k, PRIME)))])
                k *= 2
            both.append(x[:m])
        _PRIME_POWERS[:] = both
    return _PRIME_POWERS[0][:n], _PRIME_POWERS[1][:n]


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``symbols[start:end]`` for each span of any length: polynomials modulo PRIME, by prefix sums."""
    n = len(symbols)
    p, q = _prime_powers(n + 1)
    terms = mul_mod(_reduce(symbols), p[:n])
    # Prefix sums of the high and low parts apart, as their sum would leave 64 bits.
    low = np.uint64((1 << 30) - 1)
    h0, h1 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(terms & low, out=h0[1:], dtype=np.uint64)
    np.cumsum(terms >> np.uint64(30), out=h1[1:], dtype=np.uint64)
    d0, d1 = _reduce(h0[end] - h0[start]), _reduce(h1[end] - h1[start])
    d = _reduce(d0 + mul_mod(d1, np.uint64(1 << 30)))
    return mix(mul_mod(d, q[start]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``raw[start:end]``: the sum of a mixed value of each eight bytes and their place."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_BASE))
    todo, off = np.arange(len(start)), 0
    while len(todo) and off < 32:
        left = size[todo] - off
        out[todo] += mix((eight[start[todo] + off] & _FIRST[np.minimum(left, 8)]) + np.uint64((_BASE * (off + 1)) & ((1 << 64) - 1)))
        todo, off = todo[left > 8], off + 8
    if len(todo):  # the rest of long words, all their parts at once
        parts = (size[todo] - off + 7) // 8
        own = np.repeat(todo, parts)
        at = off + 8 * (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts))
        x = mix((eight[start[own] + at] & _FIRST[np.minimum(size[own] - at, 8)]) + np.uint64(_BASE) * (at + 1).astype(np.uint64))
        out[todo] += np.add.reduceat(x, np.cumsum(parts) - parts)
    return mix(out)


def words(raw: np.ndarray, at: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: byte starts and ends, the index of the first word of each row (n+1), hashes.

    ``fold`` maps bytes before hashing.
    """
    n = len(raw)
    ws = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13) | (raw == 12)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ws[:-1], ws[1:]
    before |= edge[:n]
    after |= edge[1:]
    start = np.flatnonzero(~ws & before)
    end = np.flatnonzero(~ws & after) + 1
    first = np.searchsorted(start, at)
    return start, end, first, byte_hashes(raw if fold is None else fold[raw], start, end)


def owner(first: np.ndarray) -> np.ndarray:
    """Row of each item, from the n+1 first indices."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))

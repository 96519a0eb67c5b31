"""Variable-byte and delta codecs of posting lists, and the hash keys, as functions and UDFs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = 0x80
#: Ids of a block of a posting list: what a row holds at most.
BLOCK = 1 << 16


def required_bits(n: int) -> int:
    """Bits that hold the ids of n fields, one at least."""
    return max(1, (n - 1).bit_length())


def vb_encode(numbers: list[int]) -> bytes | None:
    """Little-endian groups of seven bits, the last byte of a number marked; None if one is negative."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            return None
        while n > 127:
            out.append(n & 127)
            n >>= 7
        out.append(n | 128)
    return bytes(out)


def vb_decode(data: bytes) -> list[int]:
    """The numbers of vb_encode."""
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b > 127:
            out.append(n)
            n = shift = 0
    return out


def delta_encode(numbers: list[int]) -> list[int]:
    """Each number less the one before; the first as it is."""
    return [b - a for a, b in zip([0, *numbers], numbers)]


def delta_vb_encode(numbers: list[int]) -> bytes | None:
    """Differences plus one, from 1 on, so that no zero and no separator byte occurs."""
    return vb_encode([b - a + 1 for a, b in zip([1, *numbers], numbers)])


def vb_delta_decode(data: bytes) -> list[int]:
    """The numbers of delta_vb_encode."""
    out, at = [], 1
    for d in vb_decode(data):
        at += d - 1
        out.append(at)
    return out


def vb_delta_max(data: bytes) -> int:
    """The greatest (last) number of delta_vb_encode; 0 for none."""
    return (vb_delta_decode(data) or [0])[-1]


def encode_posting(doc_ids: list[int], positions: list[list[int]], sentiment: list[int] | None = None) -> bytes:
    """A posting list: document ids, then for each document a separator, its sentiment if any, its positions."""
    out = bytearray(delta_vb_encode(doc_ids) or b"")
    for k, pos in enumerate(positions):
        out.append(SEPARATOR)
        if sentiment is not None:
            out += vb_encode([max(-128, min(127, sentiment[k])) + 128]) or b""
        out += delta_vb_encode(sorted(pos)) or b""
    return bytes(out)


def decode_posting(data: bytes, sentiment: bool = False) -> list[tuple[int, int | None, list[int]]]:
    """(doc_id, sentiment, positions) of encode_posting."""
    ids: list[int] = []
    at, n, shift, i = 1, 0, 0, 0
    while i < len(data) and not (data[i] == SEPARATOR and not shift):
        n |= (data[i] & 127) << shift
        shift += 7
        if data[i] > 127:
            at += n - 1
            ids.append(at)
            n = shift = 0
        i += 1
    out: list[tuple[int, int | None, list[int]]] = []
    for d in ids:
        i += 1
        senti: int | None = None
        if sentiment:
            end = i
            while data[end] < 128:
                end += 1
            senti = vb_decode(data[i : end + 1])[0] - 128
            i = end + 1
        start, fresh = i, True
        while i < len(data) and not (data[i] == SEPARATOR and fresh):
            fresh = data[i] > 127
            i += 1
        out.append((d, senti, vb_delta_decode(data[start:i])))
    return out


@F.pandas_udf(T.BinaryType())
def vb_encode_udf(s: pd.Series) -> pd.Series:
    """vb_encode of each array."""
    return s.map(lambda x: vb_encode([int(v) for v in x]), na_action="ignore")


def _rows(n: np.ndarray) -> np.ndarray:
    """Starts of rows with so many items, and the end."""
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def delta_vb_encode_arrow(lists: pa.Array) -> pa.Array:
    """delta_vb_encode of each list, all at once."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    x = flat.to_numpy(zero_copy_only=False)
    if flat.null_count or (len(x) and max(x.max(), -x.min()) >= 1 << 61):
        return pa.array([None if v is None else delta_vb_encode(v) for v in lists.to_pylist()], pa.binary())
    at = _rows(size)
    d = np.diff(x, prepend=0) + 1
    first = at[:-1][size > 0]
    d[first] = x[first]
    n = np.ones(len(d), np.int64)
    for k in range(1, 9):
        n += d >= 1 << 7 * k
    to = _rows(n)
    out = np.zeros(to[-1], np.uint8)
    for k in range(int(n.max(initial=0))):
        here = np.flatnonzero(n > k)
        out[to[here] + k] = (d[here] >> 7 * k) & 127
    out[to[1:] - 1] |= 128
    data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to[at].astype(np.int32)), pa.py_buffer(out)])
    bad = np.zeros(len(size), bool)
    bad[np.repeat(np.arange(len(size)), size)[d < 0]] = True
    bad |= lists.is_null().to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(bad), pa.scalar(None, pa.binary()), data) if bad.any() else data


def _decoded(data: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """The numbers of vb_delta_decode of all values, and how many each has; None if a value ends within a number or is too great."""
    size = pc.fill_null(pc.binary_length(data), 0).to_numpy().astype(np.int64)
    b = np.frombuffer(b"".join(x for x in data.to_pylist() if x), np.uint8)
    at = _rows(size)
    end = b > 127
    if not end[at[1:][size > 0] - 1].all():
        return None
    last = np.flatnonzero(end)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    width = last - first + 1
    if len(last) and width.max() > 9:
        return None
    shift = (np.arange(len(b)) - np.repeat(first, width)) * 7
    d = np.add.reduceat((b & 127).astype(np.int64) << shift, first) - 1 if len(first) else np.zeros(0, np.int64)
    to = np.concatenate([[0], np.cumsum(end)])[at]
    n = np.diff(to)
    total = np.cumsum(d)
    return total + 1 - np.repeat(np.concatenate([[0], total])[to[:-1]], n), n


def vb_delta_decode_arrow(data: pa.Array) -> pa.Array:
    """vb_delta_decode of each value, all at once."""
    kind = pa.list_(pa.int64())
    found = _decoded(data)
    if found is None:
        return pa.array([None if x is None else vb_delta_decode(x) for x in data.to_pylist()], kind)
    out = pa.ListArray.from_arrays(pa.array(_rows(found[1]), pa.int32()), pa.array(found[0]))
    return pc.if_else(data.is_null(), pa.scalar(None, kind), out) if data.null_count else out


def vb_delta_max_arrow(data: pa.Array) -> pa.Array:
    """vb_delta_max of each value, all at once."""
    found = _decoded(data)
    if found is None:
        return pa.array([None if x is None else vb_delta_max(x) for x in data.to_pylist()], pa.int64())
    x, n = found
    return pa.array(np.where(n > 0, np.append(x, 0)[np.cumsum(n) - 1], 0), mask=data.is_null().to_numpy(zero_copy_only=False))


def _arrow(f, kind):
    def run(x: pa.Array) -> pa.Array:
        return f(x)

    return F.arrow_udf(run, kind)


delta_vb_encode_udf = _arrow(delta_vb_encode_arrow, T.BinaryType())
vb_delta_decode_udf = _arrow(vb_delta_decode_arrow, T.ArrayType(T.LongType()))
vb_delta_max_udf = _arrow(vb_delta_max_arrow, T.LongType())


def delta_encode_column(numbers: Column) -> Column:
    """delta_encode of an array column."""
    return F.transform(numbers, lambda x, i: x - F.when(i > 0, F.element_at(numbers, F.greatest(i, F.lit(1)))).otherwise(F.lit(0)))


def crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(text, "utf-8"))


def md5_head(text: Column) -> Column:
    """First 16 bits of the MD5."""
    return F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 4), 16, 10).cast("int")


def md5_head_of(text: str) -> int:
    """First 16 bits of the MD5 of a string."""
    return int(hashlib.md5(text.encode()).hexdigest()[:4], 16)


def pack_position(pos: Column, field_id: Column, n_fields: int) -> Column:
    """Position and field in one number."""
    return F.shiftleft(pos, required_bits(n_fields)) + field_id

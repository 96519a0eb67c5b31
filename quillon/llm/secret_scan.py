"""Secrets found by how badly a tokenizer's vocabulary compresses them.

Every run of 16 or more characters of keys and encodings is a candidate.  Under a byte-pair vocabulary
words take many characters a token and random strings few, so a candidate with
at most MAX_RATIO characters a token is reported, after known identifiers
(UUIDs), numbers (runs without a letter) and digests (hexadecimal of a digest's
length) are excluded.  A digest or number right after the name of a credential
and ``=`` or ``:`` is one all the same.

The regular expression runs in the JVM over every text; only documents with a
candidate reach Python.  The vocabulary is read by the driver and broadcast (a
file of a megabyte).  Runs of every length are measured in the same way, whole.

Defined results: NULL and empty texts have no secrets; each occurrence is a
row, also in repeated rows; extra columns are not read.  A run is taken apart
at ``=`` and at UUIDs and digests.  A part that is random as a whole is
reported whole; of any other the random stretches are (``stretches``), so that
words around a key do not hide it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RATIO = 2.2
WORD = 5
_C = "A-Za-z0-9+/_="
CANDIDATE = rf"[{_C}-]{{16,}}"
_FIND = re.compile(CANDIDATE)
#: Separators that join words and keys to a run.
_BETWEEN = "+/_-"
_PIECE = re.compile(r"[A-Za-z0-9]{16,}")
#: UUIDs, and hexadecimal pieces that may be digests.
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_LETTER = re.compile(r"[A-Za-z]")
_DIGESTS = {32, 40, 56, 64, 96, 128}
_CREDENTIAL = re.compile(r"key|token|secret|passwd|password|pwd|auth|bearer|credential", re.IGNORECASE)
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")


@lru_cache(4)
def from_ranks(data: bytes):
    """The tokenizer of the bytes of a file of ranks, made once a process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a file of ranks."""
    with open(path, "rb") as f:
        return from_ranks(f.read())


def ratio(run: str, enc=None) -> float:
    """Characters a token."""
    return len(run) / max(1, len((enc or encoding()).encode_ordinary(run)))


def stretches(run: str, enc=None, limit: float = MAX_RATIO) -> list[tuple[int, int]]:
    """Starts and ends of the random stretches of a run that is longer than a key.

    A stretch is what windows of whole tokens and 16 or more characters cover
    that have at most ``limit`` characters a token, without the separators and
    words (tokens of WORD or more characters) at its ends; and each piece
    between separators that is random by itself.  Short words right next to a key
    may be in its stretch.
    """
    enc = enc or encoding()
    at = [0]
    for t in enc.encode_ordinary(run):
        at.append(at[-1] + len(enc.decode_single_token_bytes(t)))
    j, spans = 0, []
    for i in range(len(at)):
        while j < len(at) and at[j] - at[i] < 16:
            j += 1
        if j == len(at):
            break
        if at[j] - at[i] <= limit * (j - i):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = j
            else:
                spans.append([i, j])
    found = []
    for i, j in spans:
        while i < j and (at[i + 1] - at[i] >= WORD or run[at[i]] in _BETWEEN):
            i += 1
        while i < j and (at[j] - at[j - 1] >= WORD or run[at[j - 1]] in _BETWEEN):
            j -= 1
        found.append((at[i], at[j]))
    found += [m.span() for m in _PIECE.finditer(run)]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(x for x in found if x[1] - x[0] >= 16 and ratio(run[slice(*x)], enc) <= limit):
        if out and lo < out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def named(text: str, end: int) -> bool:
    """Whether the name of a credential and ``=`` or ``:``, with blanks and quotes of any number of blanks, end there."""
    if end and text[end - 1] in "\"'":
        end -= 1
    while end and text[end - 1].isspace():
        end -= 1
    if not end or text[end - 1] not in ":=":
        return False
    end -= 1
    while end and text[end - 1].isspace():
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME:
        start -= 1
    return bool(_CREDENTIAL.search(text, start, end))


def parts(text: str):
    """Yields (start, part, whether a credential is named right before) of the runs of a text, without what is known to be no secret."""
    for m in _FIND.finditer(text):
        start = m.start()
        for part in m.group().rstrip("=").split("="):
            name = named(text, start)
            lo = 0
            for known in [*_KNOWN.finditer(part), None]:
                if known and _HEX.fullmatch(known.group()) and (len(known.group()) not in _DIGESTS or name and known.start() == 0):
                    continue
                piece = part[lo : known.start() if known else None]
                whole = piece.strip(_BETWEEN) if lo or known else piece
                if len(whole) >= 16 and (name and not lo or _LETTER.search(whole)):
                    yield start + lo + piece.index(whole), whole, name and not lo
                lo = known.end() if known else lo
            start += len(part) + 1


def scan(text: str, enc=None, limit: float = MAX_RATIO):
    """Yields (start, length, kind, ratio, digest, preview) of the secrets in a text."""
    for start, part, name in parts(text):
        r = ratio(part, enc)
        for lo, hi in [(0, len(part))] if r <= limit else stretches(part, enc, limit):
            run = part[lo:hi]
            if name or _LETTER.search(run):
                yield start + lo, len(run), "named" if name else "random", round(ratio(run, enc), 4), hashlib.sha256(run.encode()).hexdigest(), run[:4] + "..."


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY, limit: float = MAX_RATIO) -> DataFrame:
    """doc_id, start, length, kind, chars_per_token, sha256, preview for each secret; texts of secrets are not repeated."""
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        enc = from_ranks(ranks.value)
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for hit in scan(text, enc, limit):
                    ids.append(i)
                    out.append(hit)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string()))]], ["doc_id", "start", "length", "kind", "chars_per_token", "sha256", "preview"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CANDIDATE))
    return texts.mapInArrow(run, "doc_id long, start long, length long, kind string, chars_per_token double, sha256 string, preview string")


def op8_secret_scan(spark, sf_dir):
    """Every secret in ``documents``."""
    return secrets(common.read(spark, sf_dir, "documents"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES: dict[str, str] = {}

"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features describe its characters and
words; it also sees those of the line before and after.  Weights and
transitions are fitted by gradient descent on the likelihood of the label
sequences.  A label is known for documents, not lines, so it binds a document
as a whole: lines begin with the label of their document, and before each round
of fitting those of a bad document that the model is sure are good become so,
as long as most of its bytes stay bad (and the other way round).  The model
that does so first knows single lines only.  Two labelled documents, one
between the halves of the other, make a chain, so that the model also learns
where labels change.  At prediction the forward-backward algorithm gives each
line's marginal probability of being good; their mean weighted by line length
is the quality, and a document is kept from the limit on that tells the fitted
documents best apart.

The model is fitted on TRAIN labelled documents at most (a bounded sample by a
hash of doc_id), each whole; features are computed where the texts are, in
numpy over Arrow buffers, and only they reach the driver.

Defined results: a line weighs its bytes that are not white space; a text that
is NULL, empty or of blank lines alone has 0 lines, quality NULL and is not
kept; blank lines have no label; with no labels, or one class of them, weights
stay 0, quality is 0.5 and everything else is kept; repeated rows give repeated
rows; a doc_id with two labels takes the smaller; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN = 3000
STEPS = 100
#: Rounds of fitting, and how sure the model must be to give a line the other label than its document's.
ROUNDS = 2
SURE = 0.9
#: Steps of a chain that are worked off side by side.
PIECE = 64
#: Least marginal of a good line, and least quality of a kept document unless the fitted documents say another.
KEEP = 0.5
K = 14

_CLASS = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 white, 5 letter beyond ASCII, 6 rest of one, 7 sentence mark
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 12, 13, 32]] = 0, 1, 2, 4
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 5, 6
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 7


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and weight (bytes that are not white space) of every line, and the first line of each row (n+1)."""
    cut = np.flatnonzero(raw == 10)
    n = len(at) - 1
    start = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")  # a row may be empty, or end in a newline
    own_first = np.arange(n) + np.searchsorted(cut, at[:-1])
    first = np.append(own_first, len(start))
    ends_at = np.append(start[1:], len(raw))
    last = np.zeros(len(start), bool)
    last[first[1:] - 1] = True
    end = np.where(last, np.repeat(at[1:], np.diff(first)), ends_at - 1)
    kind = _CLASS[raw]
    size = (end - start).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return (c[end] - c[start]).astype(np.float64)

    lower, upper, digit, symbol, white, high, mark = (count(kind == k) for k in (0, 1, 2, 3, 4, 5, 7))
    ws, we, wf, h = common.words(raw, at)
    line = np.searchsorted(start, ws, "right") - 1
    m = len(start)
    words = np.bincount(line, minlength=m).astype(np.float64)
    letters = lower + upper + high
    same = np.zeros(len(ws), bool)
    if len(ws):
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    odd = kind[we - 1] == 3 if len(ws) else np.zeros(0, bool)
    one = np.maximum(size, 1)
    final = np.zeros(m, bool)
    ok = end > start
    final[ok] = np.isin(raw[end[ok] - 1], np.frombuffer(b".?!:", np.uint8))
    opens = np.zeros(m, bool)
    opens[ok] = (kind[start[ok]] == 1) | (kind[start[ok]] == 5)
    some = np.maximum(words, 1)
    f = np.stack([np.ones(m), np.log1p(size) / 8, upper / np.maximum(letters, 1), digit / one, symbol / one, letters / one, white / one, mark / one, final, opens, np.minimum(letters / some, 40) / 10, np.bincount(line[same], minlength=m) / some, np.bincount(line[odd], minlength=m) / some, np.log1p(words) / 6], 1)
    return f, size - white, first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features and those of the lines before and after it in its document; zeros beyond its ends."""
    out = np.zeros((len(f), 3 * K))
    out[:, :K] = f
    if len(f) > 1:
        out[1:, K : 2 * K] = f[:-1]
        out[:-1, 2 * K :] = f[1:]
    some = first[:-1][np.diff(first) > 0]
    out[some, K : 2 * K] = 0
    out[np.append(some[1:], len(f))[: len(some)] - 1, 2 * K :] = 0
    return out


@dataclass
class Crf:
    """Weights of a line being good, log-potentials [from, to] and of the first state; state 1 is good; least quality of a document to keep."""

    w: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    keep: float = KEEP

    def chains(self, u: np.ndarray, first: np.ndarray):
        """Forward-backward over all chains at once.

        u: unary log-potential of good.  Returns marginals of good, pairwise
        marginals summed [from, to], those of first states.  Chains are cut
        into pieces of PIECE steps.  The products of a piece's matrices are
        taken side by side and carried from piece to piece, then the steps
        within are filled in, so a chain of n lines takes n / PIECE steps.
        """
        size = np.diff(first)
        e = np.exp(np.clip(np.stack([np.zeros(len(u)), u], 1), -30, 30))
        t, s = np.exp(self.trans), np.exp(self.start)
        live = np.flatnonzero(size)
        if not len(live):
            return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
        count = -(-size[live] // PIECE)
        chain = np.repeat(live, count)
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[:-1][chain] + nth * PIECE
        length = np.minimum(PIECE, first[1:][chain] - begin)
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(PIECE), "left")

        # Row vectors go forward through t * e; ``into`` starts each piece, ``back`` ends it.
        into, back = np.zeros((len(chain), 2)), np.ones((len(chain), 2))
        several = count > 1
        heads = np.flatnonzero(nth == 0)
        if several.any():
            m = np.broadcast_to(np.eye(2), (len(chain), 2, 2)).copy()
            for step in range(int(length.max())):
                k = order[: alive[step]]
                x = m[k] @ t * e[begin[k] + step][:, None, :] if step else t * e[begin[k]][:, None, :]
                m[k] = x / x.sum((1, 2), keepdims=True)
        into[heads] = s
        for k in range(1, int(count.max())):  # the first piece starts from s itself, without a transition
            p = heads[count > k] + k
            if k == 1:
                x = (s * e[begin[p - 1]])[:, None, :] @ self._without_first(t, e, begin[p - 1], length[p - 1])
                into[p] = x[:, 0]
            else:
                into[p] = (into[p - 1][:, None, :] @ m[p - 1])[:, 0]
            into[p] /= into[p].sum(1, keepdims=True)
        for k in range(int(count.max()) - 2, -1, -1):
            p = heads[count > k + 1] + k
            back[p] = (m[p + 1] @ back[p + 1][:, :, None])[:, :, 0]
            back[p] /= back[p].sum(1, keepdims=True)

        a, b, scale = np.zeros((len(u), 2)), np.ones((len(u), 2)), np.ones(len(u))
        opening = nth == 0
        for step in range(int(length.max())):
            k = order[: alive[step]]
            i = begin[k] + step
            x = (np.where(opening[k][:, None], into[k], into[k] @ t) if step == 0 else a[i - 1] @ t) * e[i]
            scale[i] = x.sum(1)
            a[i] = x / scale[i][:, None]
        b[begin + length - 1] = back
        pair = np.zeros((2, 2))
        for step in range(int(length.max()) - 1, -1, -1):
            k = order[: alive[step]]
            k = k if step else k[~opening[k]]
            i = begin[k] + step
            x = e[i] * b[i]
            if step:
                b[i - 1] = x @ t.T
                b[i - 1] /= b[i - 1].sum(1, keepdims=True)
            z = np.einsum("ni,ij,nj->n", a[i - 1], t, x)
            pair += t * ((a[i - 1] / z[:, None]).T @ x)
        p = a * b
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        return p[:, 1], pair, p[first[:-1][live]].sum(0)

    @staticmethod
    def _without_first(t: np.ndarray, e: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Products of the matrices of pieces but for the first step."""
        m = np.broadcast_to(np.eye(2), (len(begin), 2, 2)).copy()
        for step in range(1, int(length.max())):
            k = np.flatnonzero(length > step)
            x = m[k] @ t * e[begin[k] + step][:, None, :]
            m[k] = x / x.sum((1, 2), keepdims=True)
        return m

    def marginals(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        return self.chains(with_neighbours(f, first) @ self.w, first)[0]


def fit_chains(f: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS, l2: float = 1e-3, begin: np.ndarray | None = None) -> Crf:
    """A model of lines f in chains with a label for each line, by Adam; from ``begin`` on, if given."""
    theta = np.zeros(3 * K + 6) if begin is None else begin.copy()

    def crf() -> Crf:
        return Crf(theta[: 3 * K], theta[3 * K : 3 * K + 4].reshape(2, 2), theta[3 * K + 4 :])

    if not len(label) or label.min() == label.max():
        return crf()
    x, y = f if f.shape[1] == 3 * K else with_neighbours(f, first), label.astype(np.float64)
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(y), bool)
    inner[heads] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (label[at - 1], label[at]), 1)
    begun = np.bincount(label[heads], minlength=2).astype(np.float64)
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    n = len(y)
    for step in range(1, steps + 1):
        p, pair, start = crf().chains(x @ theta[: 3 * K], first)
        g = np.concatenate([x.T @ (p - y), (pair - seen).ravel(), start - begun]) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return crf()


def relabel(p: np.ndarray, weight: np.ndarray, first: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines: their document's, but for those that the model is SURE have the other, surest first, up to less than half of its weight."""
    own = common.owner(first)
    label = good[own]
    against = np.where(label == 1, 1 - p, p)
    order = np.lexsort((-against, own))
    w = weight[order]
    run = np.cumsum(w)
    before = run - w - np.concatenate([[0], run])[first[:-1]][own[order]]
    total = np.bincount(own, weight, minlength=len(good))[own[order]]
    other = (against[order] > SURE) & (2 * (before + w) < total)
    out = label.copy()
    out[order[other]] = 1 - label[order[other]]
    return out


def fit_documents(f: np.ndarray, weight: np.ndarray, first: np.ndarray, good: np.ndarray) -> Crf:
    """A model of documents with a label each: pairs of them are chains, lines get labels of their own before each round.

    The first labels come from a model of single lines without neighbours, as
    in documents of one label a neighbour tells as much as the line itself.
    """
    own = common.owner(first)
    label = good[own]
    if not len(label) or good.min() == good.max():
        return fit_chains(np.zeros((0, 3 * K)), np.zeros(1, int), np.zeros(0, int))
    alone = np.concatenate([f, np.zeros((len(f), 2 * K))], 1)
    single = fit_chains(alone, np.arange(len(f) + 1), label)
    label = relabel(single.chains(alone @ single.w, np.arange(len(f) + 1))[0], weight, first, good)
    # The second of two documents comes between the halves of the first.
    size = np.diff(first)
    half = np.concatenate([np.arange(a, b) for k in range(0, len(good), 2) for a, b in ((first[k], first[k] + size[k] // 2), (first[k + 1], first[k + 2]) if k + 1 < len(good) else (0, 0), (first[k] + size[k] // 2, first[k + 1]))])
    pairs = np.append(first[:-1:2], first[-1])
    x = with_neighbours(f[half], pairs)
    back = np.argsort(half)
    crf = fit_chains(x, pairs, label[half])
    for _ in range(ROUNDS - 1):
        label = relabel(crf.chains(x @ crf.w, pairs)[0][back], weight, first, good)
        crf = fit_chains(x, pairs, label[half], STEPS // 2, begin=np.concatenate([crf.w, crf.trans.ravel(), crf.start]))
    # The limit that tells the fitted documents best apart, in the middle of equal ones
    total = np.bincount(own, weight, minlength=len(good))
    q = np.bincount(own, weight * crf.marginals(f, first), minlength=len(good)) / np.maximum(total, 1)
    limits = np.arange(0.5, 0.96, 0.01)
    right = np.array([((q >= x) == good)[total > 0].sum() for x in limits])
    crf.keep = float(round(np.median(limits[right == right.max()]), 2))
    return crf


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Crf:
    """The model of a sample of the labelled documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = common.hash_sample(known, train, "doc_id").collect()
    if not pick:
        return fit_chains(np.zeros((0, 3 * K)), np.zeros(1, int), np.zeros(0, int))
    part = spark.createDataFrame([(r.doc_id, int(r.quality)) for r in pick], "doc_id long, quality int")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(part), "doc_id")

    def measure(batches):
        for c in common.chunks(batches, "text"):
            raw, at = common.text_bytes(c.column(1))
            f, weight, first = line_features(raw, at)
            f = np.concatenate([f, weight[:, None]], 1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(2), pa.array([f[a:b].tobytes() for a, b in zip(first[:-1], first[1:])])], ["doc_id", "quality", "f"])

    rows = texts.select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, quality int, f binary").collect()
    # In the order of a hash, so that the fit does not depend on the order of tasks and pairs mix the labels.
    rows = sorted((int(common.mix(np.array([r.doc_id & (1 << 63) - 1], np.uint64))[0]), r.f, r.quality) for r in rows)
    f = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, K + 1) for _, x, _ in rows] or [np.zeros((0, K + 1))]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(x) // (4 * (K + 1)) for _, x, _ in rows], dtype=np.int64)]).astype(np.int64)
    return fit_documents(f[:, :K], f[:, K], first, np.array([q for _, _, q in rows], np.int64))


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, n_lines, quality, keep, good_lines (NULL for a blank one) for each row of ``docs``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for c in common.chunks(batches, "text"):
            raw, at = common.text_bytes(c.column(1))
            f, weight, first = line_features(raw, at)
            good = shared.value.marginals(f, first)
            own = common.owner(first)
            total = np.bincount(own, weight, minlength=len(c))
            q = np.bincount(own, weight * good, minlength=len(c)) / np.maximum(total, 1)
            lines = np.bincount(own, weight > 0, minlength=len(c)).astype(np.int64)
            q = np.round(np.where(total > 0, q, np.nan), 6)
            labels = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good >= KEEP, mask=weight == 0))
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(lines), pa.array(q, from_pandas=True), pa.array(q >= shared.value.keep), labels], ["doc_id", "n_lines", "quality", "keep", "good_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_lines long, quality double, keep boolean, good_lines array<boolean>")


def op1_quality_classifier(spark, sf_dir):
    """The quality of every row of ``documents``, learned from ``labels``."""
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.read(spark, sf_dir, "labels")))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}

"""Language identification by interpolated Kneser-Ney character models.

A text is folded to lower-case words of letters; each character is predicted
from up to ORDER - 1 characters before it within its word, whose start is
marked by a blank.  For each language the model has modified counts (absolute
discounting with one discount an order, continuation counts in the lower orders, raw counts for n-grams
at a word's start, as nothing precedes them).  All languages share one table:
sorted 64-bit n-gram hashes with a row of final log-probabilities, one column a
language, and another of contexts with their back-off weights.

The models are fitted on TRAIN documents of each language (labelled rows, a
bounded sample; the languages are all that the lang column names) with one
alphabet for all, and the limits of rejection on HELD_OUT others: a text is
rejected if its cross-entropy, per character, exceeds the mean of its best
language by SIGMAS standard deviations, of which a part shrinks with length,
and is past half-way to what texts in the other languages have in that model.
A language with fewer than FEW held-out rows takes that last mean for its own
and the others' deviation, so it rejects less.

Defined results: texts without letters (NULL, empty, digits) get 'und' and are
rejected; with fewer than MIN_DOCS labelled rows of all languages everything does; NULL doc_id is an ordinary
value; repeated rows give repeated rows; ties go to the first language by
name; extra columns pass through ``accepted``.  More than LANGUAGES names in
the lang column are an error, as each has a model of its own.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
TRAIN = 200
HELD_OUT = 100
MIN_DOCS = 20
SIGMAS = 6.0
FEW = 5
LANGUAGES = 1000
_SPACE = 32
_R = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def folded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, starts and ends of their words of letters, the text of each word."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[codes] if len(codes) else np.zeros(0, bool)
    edge = np.diff(np.concatenate([[False], alpha, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digit = np.concatenate([(codes >= 48) & (codes <= 57), [False]])  # runs that touch a digit are parts of codes, no words
    plain = ~(digit[start - 1] | digit[end])
    start, end = start[plain], end[plain]
    at = np.cumsum([0] + [len(t) + 1 for t in low])
    return codes, start, end, np.searchsorted(at, start, "right") - 1


def _code_hash(codes: np.ndarray) -> np.ndarray:
    return _R[codes & 0xFFFF] + codes.astype(np.uint64)


def unique_words(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one example of each distinct word, and for each word that of its distinct word."""
    h = common.byte_hashes(np.ascontiguousarray(codes).view(np.uint8), 4 * start, 4 * end)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return first, inverse


def ngram_hash(gram: str) -> int:
    """The hash that the sorted arrays hold, of one n-gram."""
    c = np.array([ord(x) for x in gram], np.uint32)
    return int(common.gram_hashes(_code_hash(c), np.array([0]), np.array([len(c)]))[0])


@dataclass
class Model:
    """Languages; sorted hashes with log-probabilities; sorted context hashes with log back-off weights; limits."""

    langs: list[str]
    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    logb: np.ndarray
    unseen: np.ndarray
    mean: np.ndarray
    foreign: np.ndarray
    var_doc: np.ndarray
    var_char: np.ndarray

    def word_scores(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of log-probabilities of each word's characters and its end, a column a language."""
        if not len(start):
            return np.zeros((0, len(self.langs)))
        size = end - start + 2  # a blank on either side
        off = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(len(start)), size)
        within = np.arange(off[-1]) - off[own]
        text = np.full(off[-1], _SPACE, np.uint32)
        inner = (within > 0) & (within < size[own] - 1)
        text[inner] = codes[start[own[inner]] + within[inner] - 1]
        sym = _code_hash(text)
        pos = np.flatnonzero(within > 0)  # all but the first blank are predicted
        have = np.minimum(within[pos] + 1, ORDER)
        total = np.zeros((len(pos), len(self.langs)))
        todo, k = np.arange(len(pos)), have.copy()
        while len(todo):
            p = pos[todo] + 1
            h = common.gram_hashes(sym, p - k[todo], p)
            i = np.searchsorted(self.grams, h)
            i[i == len(self.grams)] = 0
            hit = self.grams[i] == h
            total[todo[hit]] += self.logp[i[hit]]
            todo = todo[~hit]
            last = k[todo] == 1
            total[todo[last]] += self.unseen
            todo = todo[~last]
            p = pos[todo]
            c = common.gram_hashes(sym, p + 1 - k[todo], p)
            j = np.searchsorted(self.contexts, c)
            j[j == len(self.contexts)] = 0
            seen = self.contexts[j] == c
            total[todo[seen]] += self.logb[j[seen]]
            k[todo] -= 1
        return np.add.reduceat(total, np.searchsorted(own[pos], np.arange(len(start))), axis=0)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters, and cross-entropy in nats a character under each language, of each text."""
        codes, start, end, own = folded_words(texts)
        first, inverse = unique_words(codes, start, end)
        each = self.word_scores(codes, start[first], end[first])
        n = np.bincount(own, end - start + 1, minlength=len(texts))
        sums = np.stack([np.bincount(own, each[inverse, k], minlength=len(texts)) for k in range(len(self.langs))], 1)
        return n, -sums / np.maximum(n, 1)[:, None]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its cross-entropy, and whether it is rejected, of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        n, ce = self.score(texts)
        best = ce.argmin(1)
        low = ce[np.arange(len(texts)), best]
        limit = self.mean[best] + SIGMAS * np.sqrt(self.var_doc[best] + self.var_char[best] / np.maximum(n, 1))
        limit = np.maximum(limit, (self.mean + self.foreign)[best] / 2)
        none = n == 0
        low[none] = np.nan
        return [("und" if z else self.langs[b]) for b, z in zip(best, none)], low, none | ~(low <= limit)


def kneser_ney(words: dict[str, int], alphabet: int | None = None) -> tuple[dict[str, float], dict[str, float], float]:
    """Interpolated probabilities of seen n-grams, back-off weights of seen contexts, probability of an unseen character."""
    raw = [Counter() for _ in range(ORDER + 1)]
    for w, n in words.items():
        t = f" {w} "
        for i in range(1, len(t)):
            for k in range(1, min(ORDER, i + 1) + 1):
                raw[k][t[i + 1 - k : i + 1]] += n
    counts: list[Counter] = [Counter() for _ in range(ORDER + 1)]
    counts[ORDER] = raw[ORDER]
    for k in range(ORDER - 1, 0, -1):
        for g in raw[k + 1]:
            counts[k][g[1:]] += 1
        for g, n in raw[k].items():
            if g[0] == " " and len(g) > 1:
                counts[k][g] = n
    alphabet = alphabet or len(counts[1]) + 1
    prob: dict[str, float] = {}
    back: dict[str, float] = {}
    for k in range(1, ORDER + 1):
        once = sum(1 for n in counts[k].values() if n == 1)
        twice = sum(1 for n in counts[k].values() if n == 2)
        d = once / (once + 2 * twice) if once and twice else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        for h, n in total.items():
            back[h] = d * kinds[h] / n
        for g, n in counts[k].items():
            lower = prob.get(g[1:], 0) if k > 1 else 1 / alphabet
            prob[g] = (n - d) / total[g[:-1]] + back[g[:-1]] * lower
    return prob, back, (back.get("", 1.0)) / alphabet


def _probability(g: str, prob: dict, back: dict, unseen: float) -> float:
    weight = 1.0
    while g not in prob:
        if len(g) == 1:
            return weight * unseen
        weight *= back.get(g[:-1], 1.0)
        g = g[1:]
    return weight * prob[g]


def build(words: dict[str, dict[str, int]], alphabet: int | None = None) -> Model:
    """Models of the languages' word counts, over an alphabet of that size or each over its own; without limits of rejection."""
    langs = sorted(words)
    fitted = [kneser_ney(words[x], alphabet) for x in langs]
    grams = sorted({g for p, _, _ in fitted for g in p})
    contexts = sorted({h for _, b, _ in fitted for h in b})
    n = len(langs)
    logp = np.log(np.array([[_probability(g, *f) for f in fitted] for g in grams]).reshape(len(grams), n))
    logb = np.log(np.array([[b.get(h, 1.0) for _, b, _ in fitted] for h in contexts]).reshape(len(contexts), n))

    def table(keys: list[str], values: np.ndarray):
        c = np.array([ord(x) for k in keys for x in k], np.uint32)
        ends = np.cumsum([len(k) for k in keys], dtype=np.int64) if keys else np.zeros(0, np.int64)
        h = common.gram_hashes(_code_hash(c), np.concatenate([[0], ends[:-1]]).astype(np.int64) if keys else ends, ends)
        order = np.argsort(h)
        return h[order], values[order]

    (gh, gv), (ch, cv) = table(grams, logp), table(contexts, logb)
    z = np.zeros(n)
    return Model(langs, gh, gv, ch, cv, np.log(np.array([u for _, _, u in fitted])) if n else z, z.copy(), np.full(n, -np.inf), z.copy(), z.copy())


def fit(docs: DataFrame) -> Model:
    """Models and limits from the labelled rows of ``docs``, sampled by a hash of doc_id."""
    spark = docs.sparkSession
    common.small_batches(spark)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    named = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    kinds = named.groupBy("lang").count().limit(LANGUAGES + 1).count()
    if kinds > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in lang: map them to fewer")
    pick = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN + HELD_OUT).select("doc_id", "lang", "n").collect()
    size = Counter(r.lang for r in pick)
    cutoff = {x: min(TRAIN, max(1, size[x] * 2 // 3)) for x in size}
    if len(pick) < MIN_DOCS:
        return build({})
    part = spark.createDataFrame([(r.doc_id, r.lang, r.n <= cutoff[r.lang]) for r in pick], "doc_id long, label string, train boolean")
    # At most TRAIN + HELD_OUT rows a language; read once for both uses.
    rows = common.cut(docs.select("doc_id", "text", "lang").join(F.broadcast(part), "doc_id").where("lang = label").select("text", "label", "train"))

    def count(batches):
        for b in batches:
            codes, start, end, own = folded_words(b.column("text").to_pylist())
            langs = np.array(b.column("label").to_pylist(), object)
            for x in set(langs[own]):
                use = np.flatnonzero(langs[own] == x)
                c = Counter("".join(map(chr, codes[start[i] : end[i]])) for i in use)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["label", "word", "n"])

    words: dict[str, dict[str, int]] = {x: {} for x in size}
    for r in rows.where("train").select("text", "label").mapInArrow(count, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).collect():
        words[r.label][r.word] = r.n
    # One alphabet: else a language of a few characters would give an unseen one much.
    model = build({x: w for x, w in words.items() if w}, len({c for w in words.values() for x in w for c in x}) + 2)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        m = shared.value
        for b in batches:
            texts, labels = b.column("text").to_pylist(), b.column("label").to_pylist()
            n, ce = m.score(texts)
            codes, start, end, own = folded_words(texts)
            col = np.array([m.langs.index(x) if x in m.langs else -1 for x in labels])
            k = col[own]
            s = -m.word_scores(codes, start, end)
            sizes = end - start + 1
            dev = (s[np.arange(len(k)), k] - sizes * ce[own, k]) ** 2 if len(k) else np.zeros(0)
            spread = np.bincount(own, dev, minlength=len(texts)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(n), pa.array(ce[np.arange(len(texts)), col]), pa.array(spread), pa.array(ce.tolist(), pa.list_(pa.float64()))], ["label", "n", "ce", "spread", "each"])

    held = rows.where("NOT train").select("text", "label").mapInArrow(measure, "label string, n double, ce double, spread double, each array<double>").toPandas()
    few = []
    for i, x in enumerate(model.langs):
        h = held[(held["label"] == x) & (held["n"] > 0)]
        if len(h):
            model.mean[i] = np.average(h["ce"], weights=h["n"])
            model.var_char[i] = np.average(h["spread"], weights=h["n"])
            model.var_doc[i] = max(1e-4, float(np.mean((h["ce"] - model.mean[i]) ** 2 - model.var_char[i] / h["n"])))
        other = held[(held["label"] != x) & (held["n"] > 0)]
        if len(other):
            model.foreign[i] = float(np.mean([e[i] for e in other["each"]]))
        if len(h) < FEW:
            few.append(i)
    sure = [i for i in range(len(model.langs)) if i not in few]
    for i in few:
        known = np.isfinite(model.foreign[i])
        model.mean[i], model.var_doc[i] = model.foreign[i] if known else np.inf, 0.0
        model.foreign[i] = model.mean[i]
        model.var_char[i] = max((model.var_char[j] for j in sure), default=0.0)
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_id, cross_entropy, rejected for each row of ``docs``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        for c in common.chunks(batches, "text"):
            lang, ce, rejected = shared.value.decide(c.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(lang, pa.string()), pa.array(np.round(ce, 6), from_pandas=True), pa.array(rejected)], ["doc_id", "lang_id", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_id string, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are; texts pass through Python once and never through a shuffle."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def run(batches):
        for c in common.chunks(batches, "text"):
            _, _, rejected = shared.value.decide(c.column(at).to_pylist())
            yield c.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark, sf_dir):
    """The language of every row of ``documents``."""
    return identify(common.read(spark, sf_dir, "documents"))


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}

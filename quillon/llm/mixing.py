"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a share of the token budget by its weight; a source that has
too little gives all and the rest goes to the others.  The quotient is the
inclusion probability of its documents.  The flight phase takes three
documents at a time and moves their probabilities along the null space of the
two constraints (tokens, documents) until one is 0 or 1, so the expected
tokens and documents of the source are kept exactly.  Hash shards of a source
fly on their own; each leaves at most two undecided documents, which fly
together in coarser shards, then in their source, then across sources.  The
landing problem is what three documents or fewer leave: the token constraint
is dropped, then the last document is drawn.

Random numbers come from the seed and the shard, so runs repeat.

Defined results: a NULL source is a source of its own; a document without
words counts 0 tokens; rows of one doc_id are one document with their tokens
summed and the smallest source; rows without a doc_id are a document for each
source and text, and fly with the others; sources without a weight have weight
0 if weights are given; an empty table gives no rows; extra columns pass
through ``mix``.  Beyond SOURCES sources it is an error, as the driver holds a
row of each.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of all tokens that the mixture takes.
BUDGET = 0.5
SHARD = 20_000
FAN_IN = 64
SEED = 17
SOURCES = 1_000_000
_EPS = 1e-9


def allot(tokens: dict, weights: dict | None, budget: float) -> dict:
    """Inclusion probability of each source: weights times budget, capped at what a source has, the excess shared out again."""
    w = {s: 1.0 for s in tokens} if weights is None else {s: float(weights.get(s, 0)) for s in tokens}
    todo = {s for s in tokens if w[s] > 0 and tokens[s] > 0}
    pi = {s: 0.0 for s in tokens}
    left = float(budget)
    while todo:
        scale = left / sum(w[s] for s in todo)
        full = {s for s in todo if w[s] * scale >= tokens[s]}
        if not full:
            pi.update({s: w[s] * scale / tokens[s] for s in todo})
            break
        pi.update({s: 1.0 for s in full})
        left -= sum(tokens[s] for s in full)
        todo -= full
    for s in tokens:  # a source of empty documents costs nothing
        if tokens[s] == 0 and w[s] > 0:
            pi[s] = 1.0
    return pi


def flight(pi: list[float], tokens: list[int], rng: random.Random, balance: bool = True) -> list[float]:
    """Probabilities after moves that keep their sum and, if ``balance``, their sum of tokens; at most two (one) stay undecided."""
    pi = list(pi)
    size = 3 if balance else 2
    live: list[int] = []
    for nxt in range(len(pi) + 1):
        while len(live) == size:
            if balance:
                a, b, c = (tokens[i] for i in live)
                u = (c - b, a - c, b - a)
                if not any(u):
                    u = (1, -1, 0)
            else:
                u = (1, -1)
            up = down = float("inf")
            for i, x in zip(live, u):
                if x > 0:
                    up, down = min(up, (1 - pi[i]) / x), min(down, pi[i] / x)
                elif x < 0:
                    up, down = min(up, -pi[i] / x), min(down, (pi[i] - 1) / x)
            step = up if rng.random() * (up + down) < down else -down
            keep = []
            for i, x in zip(live, u):
                pi[i] += step * x
                if pi[i] < _EPS:
                    pi[i] = 0.0
                elif pi[i] > 1 - _EPS:
                    pi[i] = 1.0
                else:
                    keep.append(i)
            live = keep
        if nxt < len(pi) and 0 < pi[nxt] < 1:
            live.append(nxt)
    return pi


def landing(pi: list[float], tokens: list[int], rng: random.Random) -> list[float]:
    """Decides what the flight left: documents balanced alone, then one draw."""
    pi = flight(pi, tokens, rng, balance=False)
    return [p if p in (0.0, 1.0) else float(rng.random() < p) for p in pi]


def _unit():
    """What tells documents without a doc_id apart; 0 for those that have one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())).otherwise(F.lit(0))


def sample(docs: DataFrame, weights: dict | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, tokens, probability, selected of each document."""
    return _decided(docs, weights, budget).drop("unit")


def _decided(docs: DataFrame, weights: dict | None, budget: float) -> DataFrame:
    """``sample`` with the unit that tells documents without a doc_id apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _unit().alias("unit"), F.col("source").cast("string").alias("source"), common.n_words().alias("tokens"))
    units = common.cut(rows.groupBy("doc_id", "unit").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")))
    # One row for each source: a configured list, to which the weights are given.
    found = units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: map them to fewer before mixing")
    totals = {r.source: (r.tokens, r.n) for r in found}
    tokens = {s: t for s, (t, _) in totals.items()}
    pi = allot(tokens, weights, budget * sum(tokens.values()))
    shares = spark.createDataFrame([(s, pi[s], -(-n // SHARD)) for s, (_, n) in totals.items()], "s string, probability double, shards long")
    live = units.join(common.sized(shares), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    live = live.withColumns({"p": F.col("probability"), "shard": F.pmod(F.when(F.col("doc_id").isNull(), F.col("unit")).otherwise(F.xxhash64("doc_id")), F.col("shards"))})
    schema = "doc_id long, unit long, source string, tokens long, probability double, shards long, p double, shard long"
    live = live.select("doc_id", "unit", "source", "tokens", "probability", "shards", "p", "shard")

    def fly(last: bool):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("p", "ascending"), ("doc_id", "ascending"), ("unit", "ascending")])
            ids, tok, p = (t.column(k).to_pylist() for k in ("doc_id", "tokens", "p"))
            rng = random.Random(f"{SEED}/{t.column('source')[0].as_py()}/{t.column('shard')[0].as_py()}/{last}")
            order = list(range(len(ids)))
            rng.shuffle(order)
            moved = flight([p[i] for i in order], [tok[i] for i in order], rng)
            if last:
                moved = landing(moved, [tok[i] for i in order], rng)
            out = [0.0] * len(ids)
            for i, x in zip(order, moved):
                out[i] = x
            return t.set_column(t.schema.get_field_index("p"), "p", pa.array(out, pa.float64()))

        return run

    shards = max([n for _, n in totals.values()], default=0) // SHARD + 1
    done: DataFrame | None = None
    keys = ["source", "shard"]
    while True:
        flown = common.cut(live.groupBy(*keys).applyInArrow(fly(not keys), schema))
        fixed = flown.where("p IN (0D, 1D)")
        done = fixed if done is None else done.unionByName(fixed)
        if not keys:
            break
        live = flown.where("p NOT IN (0D, 1D)")
        if shards > 1:
            live = live.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
            shards = -(-shards // FAN_IN)
        else:
            keys = []
    return done.select("doc_id", "unit", "source", "tokens", F.round("probability", 9).alias("probability"), (F.col("p") == 1).alias("selected"))


def mix(docs: DataFrame, weights: dict | None = None, budget: float = BUDGET) -> DataFrame:
    """The selected rows of ``docs``, in its columns."""
    cols = docs.columns
    unit, i, u = (common.fresh(cols, k) for k in ("unit", "id_", "unit_"))
    chosen = common.cut(_decided(docs, weights, budget).where("selected").select(F.col("doc_id").alias(i), F.col("unit").alias(u)))
    named, other = common.cut(chosen.where(F.col(i).isNotNull()).select(F.col(i).alias("doc_id"))), common.cut(chosen.where(F.col(i).isNull()).select(u))
    kept = docs.join(common.sized(named), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in cols])
    if other.isEmpty():
        return kept
    rest = docs.where(F.col("doc_id").isNull()).withColumn(unit, _unit())
    rest = rest.join(common.sized(other), F.col(unit) == F.col(u), "left_semi")
    return kept.unionByName(rest.select(*[F.col(f"`{c}`") for c in cols]))


def op10_source_mixing(spark, sf_dir):
    """Which documents of ``documents`` make an even mixture of its sources with half of the tokens."""
    return sample(common.read(spark, sf_dir, "documents"))


QUERIES = {"op10_source_mixing": op10_source_mixing}
ORACLES: dict[str, str] = {}

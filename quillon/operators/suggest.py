"""Spelling suggestions from metaphone, edit distance and document frequency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.analyzer import FOLDS
from ..functions.linguistics import metaphone_int, stem_keyword
from ..plans.query import Query
from .index import Index
from .search import Expansion


def allowed_distance(token: str) -> int:
    """Edits a word of that length may have."""
    n = len(token.encode())
    return 3 if n >= 8 else 2 if n >= 6 else 1


def candidates(index: Index, token: str, stem: str):
    """token, doc_matches, distance, partial of dictionary words that sound alike and are close; nearest first."""
    d = allowed_distance(token)
    near = F.levenshtein(F.lit(token), F.col("token"))
    bounds = F.octet_length("token").between(len(token.encode()) - d, len(token.encode()) + d)
    partial = F.col("token").contains(token) | (F.lit(bool(stem)) & F.col("token").contains(stem or token))
    found = index.dictionary.where((F.col("metaphone") == metaphone_int(token)) & bounds & (F.col("token") != token))
    return found.select("token", "doc_matches", near.alias("distance"), partial.alias("partial")).where(partial | (F.col("distance") <= d))


def suggest_word(token: str, exact: int, expanded: int, documents: int, rows: list) -> str | None:
    """A better word, from candidate rows (token, doc_matches, distance, partial); None if the word is fine."""
    partial = sorted((r for r in rows if r[3]), key=lambda r: (r[2], -r[1], r[0]))
    others = sorted((r for r in rows if not r[3]), key=lambda r: (r[2], -r[1], r[0]))
    best = partial[0] if partial else None
    if expanded:
        most = expanded
    else:
        most = max(exact, round(documents ** (1 / 8)), 1) + sum(r[1] for r in partial)
    for word, matches, distance, _ in others:
        if matches >= most ** (1 + distance) and matches > most:
            if best and best[2] <= distance and best[1] >= matches and best[1] >= most:
                return best[0] if best[0] != token else None
            return word
    if not others and not exact and best:
        return best[0]
    return None


def did_you_mean(index: Index, text: str, query: Query, terms: list[Expansion]) -> str | None:
    """The query with better words in place of rare ones; None if there are none."""
    out = text
    for t in dict.fromkeys((t.token, t.q) for t in query.wanted):
        token, q = t
        plain = "".join(FOLDS.get(c, c) for c in token)
        if len(token.encode()) < 4 or not (plain.isascii() and plain.isalpha()):
            continue
        stem = stem_keyword(plain, index.settings.prefix_length)[0]
        rows = [tuple(r) for r in candidates(index, plain, stem).collect()]
        exact = sum(x.matches for x in terms if x.q == q and x.quality == 1.0)
        expanded = sum(x.matches for x in terms if x.q == q and x.quality < 1.0)
        better = suggest_word(plain, exact, exact + expanded if expanded else 0, index.documents, rows)
        if better:
            out = out.replace(token, better)
    return out if out != text else None

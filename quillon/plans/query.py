"""Query strings and search options: parsed and checked on the driver, where they are tiny."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import IntEnum

from ..functions.analyzer import Analysis
from ..functions.linguistics import stem_keyword


class QueryError(ValueError):
    """A query or option that makes no sense."""


class Match(IntEnum):
    """Which documents match."""

    ANY = 1
    ALL = 2
    STRICT = 3


class Rank(IntEnum):
    """What the score is made of."""

    PROXIMITY_BM25 = 1
    BM25 = 2
    PROXIMITY = 3


class Sort(IntEnum):
    """What results are ordered by."""

    RELEVANCE = 1
    ATTRIBUTE = 2
    POSITIVITY = 3
    NEGATIVITY = 4


_VIRTUAL = {"@rank": "@score", "@weight": "@score"}


def parse_order(expression: str) -> tuple[str, bool]:
    """(attribute, ascending) of ``attr asc|desc``; descending by default."""
    parts = expression.split()
    if not 1 <= len(parts) <= 2 or (len(parts) == 2 and parts[1].lower() not in ("asc", "desc")):
        raise QueryError(f"expected 'attribute asc|desc', got {expression!r}")
    return _VIRTUAL.get(parts[0], parts[0]), len(parts) == 2 and parts[1].lower() == "asc"


@dataclass(frozen=True)
class SearchOptions:
    """Everything about a search but its words.

    filters: attribute to values, ``!attribute`` negates; values of one
    attribute are alternatives, attributes must all hold.  ranges: attribute to
    (low, high), both included; negated, below or at low or at or above high.
    senti_scale: None blends by relevance, 0 to 100 is the documents' share.
    strict_missing: a word that no document has empties ANY results too.
    contiguous: a phrase must stand in one place, not pair by pair.
    """

    match: Match = Match.ALL
    rank: Rank = Rank.PROXIMITY_BM25
    sort: Sort = Sort.RELEVANCE
    sort_by: str | None = None
    group_by: str | None = None
    group_sort: str = "@score desc"
    filters: dict[str, tuple[int, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: dict[str, int] | None = None
    stemming: bool = True
    dialect_matching: bool = True
    quality_scoring: bool = True
    prefix_quality: int = 0
    stem_quality: int = 0
    expansion_limit: int = 32
    sentiweight: bool = False
    senti_scale: int | None = None
    strict_missing: bool = False
    contiguous: bool = False

    def check(self, attributes: set[str]) -> SearchOptions:
        """Itself, with enumerations for plain numbers; raises QueryError where something is unknown."""
        try:
            out = replace(self, match=Match(self.match), rank=Rank(self.rank), sort=Sort(self.sort))
        except ValueError as e:
            raise QueryError(str(e)) from None
        known = attributes | {"@id", "@score", "@count", "@sentiscore"}
        for a in [*self.filters, *self.ranges]:
            if a.lstrip("!") not in attributes:
                raise QueryError(f"unknown attribute {a!r}")
        if self.group_by is not None and self.group_by not in attributes:
            raise QueryError(f"unknown attribute {self.group_by!r}")
        for low, high in self.ranges.values():
            if low > high:
                raise QueryError("a range ends before it begins")
        for e in [self.group_sort, *([self.sort_by] if self.sort_by else [])]:
            if parse_order(e)[0] not in known:
                raise QueryError(f"unknown attribute in {e!r}")
        if out.sort == Sort.ATTRIBUTE and not self.sort_by:
            raise QueryError("sorting by attribute needs sort_by")
        if self.sort_by and parse_order(self.sort_by)[0] == "@count" and self.group_by is None:
            raise QueryError("@count needs group_by")
        for name, v, top in (("prefix_quality", self.prefix_quality, 100), ("stem_quality", self.stem_quality, 100), ("expansion_limit", self.expansion_limit, 255), ("senti_scale", self.senti_scale or 0, 100)):
            if not 0 <= v <= top:
                raise QueryError(f"{name} is not between 0 and {top}")
        return out


@dataclass(frozen=True)
class Term:
    """A query position: its token, its quote or bracket group (0: none), and how it may match."""

    q: int
    token: str
    group: int
    negative: bool
    exact: bool
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    """The positions of a query in order."""

    terms: tuple[Term, ...]

    @property
    def wanted(self) -> list[Term]:
        """Positions that are not negated."""
        return [t for t in self.terms if not t.negative]

    @property
    def pairs(self) -> int:
        """Bit q for each wanted position whose successor in the query must follow it in the text."""
        w = self.wanted
        return sum(1 << a.q for a, b in zip(w, w[1:]) if a.group and a.group == b.group and b.q == a.q + 1)


def clean(query: str, a: Analysis) -> str:
    """The query in token characters, quotes, brackets and stars; a minus before a word stays."""
    q = query.lower().translate(str.maketrans(a.outside_folds))
    if a.separate_alnum:
        q = re.sub(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ", q)
    for c in a.ignore_chars:
        q = q.replace(c, "")
    q = re.sub(rf'[^{a.keep_class}*"()]', " ", q)
    for c in a.blend_chars:
        for edge in (f" {c} ", f"{c} ", *([f" {c}"] if c != "-" else [])):
            q = q.replace(edge, " ")
    return q


def parse(query: str, a: Analysis, options: SearchOptions, prefix_length: int = 3) -> Query:
    """Tokens with their groups, negations and expansion keys."""
    q = clean(query, a)
    grouping = q.count('"') % 2 == 0 and q.count("(") == q.count(")")
    words = re.sub(r'(["()])', r" \1 ", q).split()
    terms: list[Term] = []
    group, quoted, bracketed = 0, False, False
    for w in words:
        if w == '"':
            group += grouping and not quoted
            quoted = grouping and not quoted
        elif w == "(":
            if grouping and not quoted:
                group, bracketed = group + 1, True
        elif w == ")":
            bracketed = False
        elif w != "-":
            negative, exact = w.startswith("-"), quoted
            if negative:
                w = w[1:]
            elif w.endswith("*"):
                w, exact = w[:-1], True
            w = w.strip("*")
            if w in a.forbidden:
                continue
            terms.append(Term(len(terms), w, group if quoted or bracketed else 0, negative, exact, () if exact else tuple(expansion_keys(w, a, options, prefix_length))))
    if len(terms) > 62:
        raise QueryError("more than 62 words")
    return Query(tuple(terms))


def expansion_keys(token: str, a: Analysis, options: SearchOptions, prefix_length: int) -> list[str]:
    """Prefix-index keys under which longer or accented forms of the token stand."""
    keys = []
    if options.dialect_matching and a.inside_folds and not token.isdigit():
        folded = token.translate(str.maketrans(a.inside_folds))
        if folded != token:
            keys.append(folded)
    if options.stemming:
        stem, least = stem_keyword(token, prefix_length, options.stem_quality)
        if stem and least < len(token):
            keys += [stem, token]
        elif least >= prefix_length:
            keys.append(token)
    return list(dict.fromkeys(keys))

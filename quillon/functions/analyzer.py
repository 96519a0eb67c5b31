"""Text to tokens as Column expressions: normalising, folding, blended words, positions.

Everything here runs in the JVM.  The order of the steps is part of the
semantics: white space, ignored characters, accent folding, character filter,
edges of blend characters, then (optionally) letter/digit separation.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿšžčşğıǐĭḯĩȋμ$"
_SPECIAL = dict(zip("æðøþıμ$", "adobius"))


def _plain(c: str) -> str:
    return _SPECIAL.get(c) or unicodedata.normalize("NFD", c)[0]


#: Accented letters and what they fold to, one to one.
FOLDS: dict[str, str] = {c: _plain(c) for c in _ACCENTED}


@dataclass(frozen=True)
class Analysis:
    """What a token is made of.

    charset: body of a regular-expression class; blend_chars: characters kept
    inside words; ignore_chars: characters dropped; synonyms: comma-separated
    lists whose members stand for each other.
    """

    charset: str = "0-9a-zöäå#$"
    blend_chars: tuple[str, ...] = (".", "-", "&")
    ignore_chars: tuple[str, ...] = ("'",)
    separate_alnum: bool = False
    dialect: bool = True
    synonyms: tuple[str, ...] = ()
    strip_tags: bool = False
    remove_elements: tuple[str, ...] = ()
    index_attrs: tuple[str, ...] = ()

    @property
    def outside_folds(self) -> dict[str, str]:
        """Folds of letters that are no tokens characters: applied to all text."""
        return {c: p for c, p in FOLDS.items() if c not in self.charset} if self.dialect else {}

    @property
    def inside_folds(self) -> dict[str, str]:
        """Folds of letters that are kept: they give extra dictionary entries."""
        return {c: p for c, p in FOLDS.items() if c in self.charset} if self.dialect else {}

    @property
    def forbidden(self) -> tuple[str, ...]:
        """Tokens that take no position."""
        return ("", *(c for c in self.blend_chars if c not in self.charset))

    @property
    def keep_class(self) -> str:
        """Body of the class of characters that survive."""
        return self.charset + "".join(re.escape(c) for c in self.blend_chars)


DEFAULT = Analysis()


def fold(text: Column, pairs: dict[str, str]) -> Column:
    """The text with each key of ``pairs`` replaced by its value."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


def normalise(text: Column, a: Analysis = DEFAULT) -> Column:
    """Lower-cased text of token characters, blend characters and blanks; NULL counts as empty."""
    x = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    if a.strip_tags:
        from . import html

        x = html.to_text(x, a.remove_elements, a.index_attrs)
    x = F.lower(x)
    x = F.regexp_replace(x, r"\r\n|\n\r|[\t\n\r]|&#13;", " ")
    for c in a.ignore_chars:
        x = F.replace(x, F.lit(c), F.lit(""))
    x = fold(x, a.outside_folds)
    x = F.regexp_replace(x, f"[^ {a.keep_class}]", " ")
    for c in a.blend_chars:
        for edge in (f" {c} ", f" {c}", f"{c} "):
            x = F.replace(x, F.lit(edge), F.lit(" "))
    if a.separate_alnum:
        x = F.regexp_replace(x, r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ")
    return x


def spaced(text: Column, a: Analysis = DEFAULT) -> Column:
    """The tokens of ``normalise`` between blanks, in fewer passes; members of ``forbidden`` may be among them.

    Blanks need no count here, so ignored characters, folds and all of ASCII
    that is no part of a token are one translation, which is many times faster
    than a class of a regular expression; that is left to texts with other
    letters than the charset has.
    """
    if a.strip_tags:
        return normalise(text, a)
    x = F.lower(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")))
    x = F.replace(x, F.lit("&#13;"), F.lit(" "))
    keep = re.compile(f"[ {a.keep_class}]")
    to = {c: " " for c in map(chr, range(128)) if not keep.match(c)}
    to |= {c: p if keep.match(p) else " " for c, p in a.outside_folds.items()}
    to = {c: p for c, p in to.items() if c not in a.ignore_chars}
    # What has no counterpart is dropped.
    x = F.translate(x, "".join([*to, *a.ignore_chars]), "".join(to.values()))
    known = "".join(c for c in map(chr, range(128, 0x3000)) if keep.match(c))
    rest = F.translate(x, known, "") if known else x
    x = F.when(F.octet_length(x) == F.length(x), x).when(F.octet_length(rest) == F.length(rest), x).otherwise(F.regexp_replace(x, f"[^ {a.keep_class}]+", " "))
    for c in a.blend_chars:
        for edge in (f" {c} ", f" {c}", f"{c} "):
            x = F.replace(x, F.lit(edge), F.lit(" "))
    if a.separate_alnum:
        x = F.regexp_replace(x, r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ")
    return x


def tokens(text: Column, a: Analysis = DEFAULT) -> Column:
    """Array of the tokens that take a position, in order."""
    out = F.split(spaced(text, a), " ")
    for t in a.forbidden:
        out = F.array_remove(out, t)
    return out


def blend_parts(token: Column, a: Analysis = DEFAULT) -> Column:
    """Parts of a word joined by one kind of blend character, else an empty array.

    Single characters, more than two of them, are put together: s.t.a.r gives star.
    """
    parts = F.array().cast("array<string>")
    for c in a.blend_chars:
        q = re.escape(c)
        inner = F.regexp_replace(token, f"^{q}+|{q}+$", "")
        split = F.split(inner, q)
        joined = F.replace(inner, F.lit(c), F.lit(""))
        whole = (F.size(split) == F.length(joined)) & (F.length(joined) > 2)
        some = F.when(whole, F.array(joined)).otherwise(F.filter(split, lambda p: p != ""))
        parts = F.when(token.rlike(rf"^[\p{{L}}\p{{N}}_{q}]+$") & token.rlike(f"^.+{q}.+$"), some).otherwise(parts)
    return parts


def expand_synonyms(lists: tuple[str, ...]) -> dict[str, list[str]]:
    """Each word with the other members of the first list that has it."""
    out: dict[str, list[str]] = {}
    for row in lists:
        members = list(dict.fromkeys(w.strip().lower() for w in row.split(",") if w.strip()))
        for w in members:
            out.setdefault(w, [m for m in members if m != w])
    return {w: m for w, m in out.items() if m}


#: Bytes of stored input of a partition of texts, as they become many times that.
PARTITION_BYTES = 8 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions for work that bytes say little of: those of a shuffle, a core each at least; more where the tables that ``df`` reads need them."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if df is None:
        return least
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    # Plans of unknown size have that of the greatest long.
    return max(least, sum(n for n in sizes if n < 1 << 50) // PARTITION_BYTES)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch unless the caller did, so that long texts fit a Python worker."""
    key, unset = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 2)
    if spark.conf.get(key, unset) == unset:
        spark.conf.set(key, str(size))


def occurrences(docs: DataFrame, doc_id: str, fields: list[str], a: Analysis = DEFAULT) -> DataFrame:
    """doc_id, field_id, pos, token for every hit of every field: each token, parts of blended words from its position on, synonyms at it.

    Positions count from 1 in each field.  Rows are spread by doc_id before the
    texts are taken apart: a table may be a single row group, and grouping by
    document then needs no further shuffle of what is many times the text.
    """
    table = expand_synonyms(a.synonyms)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).repartition(partitions(docs.sparkSession, docs), "doc_id")
    if len(fields) > 1:
        rows = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("field_id"), F.col(f"f{i}").alias("f0")) for i in range(len(fields))])).alias("x")).select("doc_id", "x.*")
    else:
        rows = rows.withColumn("field_id", F.lit(0))
    flat = rows.select("doc_id", "field_id", F.posexplode(tokens(F.col("f0"), a)).alias("i", "token"))
    # Tokens are rows now: the few with blend characters or synonyms are taken apart, the rest pass in compiled code.
    t = F.col("token")

    def at(pos: Column, token: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), token.alias("token"))

    own = F.array(at(F.col("i") + 1, t))
    parts = F.transform(blend_parts(t, a), lambda p, k: at(F.col("i") + 1 + k, p))
    blended = reduce(or_, [t.contains(c) for c in a.blend_chars], F.lit(False))
    hits = F.when(blended, F.concat(own, parts)).otherwise(own) if a.blend_chars else own
    if table:
        known = F.create_map(*[x for w, m in table.items() for x in (F.lit(w), F.array(*map(F.lit, m)))])
        hits = F.when(t.isin(*table), F.concat(hits, F.transform(F.element_at(known, t), lambda s: at(F.col("i") + 1, s)))).otherwise(hits)
    return flat.select("doc_id", "field_id", F.explode(hits).alias("h")).select("doc_id", "field_id", "h.pos", "h.token")


def trim_title(title: Column, endings: list[str]) -> Column:
    """A page title without the configured strings, whatever their case."""
    for e in endings:
        title = F.regexp_replace(title, "(?i)" + re.escape(e), "")
    return F.trim(title)

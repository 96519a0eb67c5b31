"""Rows to index: SQL sources, their split into id, fields and attributes, ranges and increments, sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the column that tags a row's language (1 English, 2 Finnish), unless the caller names another.
LANGUAGE = "language_tag"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class SourceError(ValueError):
    """A source that cannot be indexed."""


@dataclass(frozen=True)
class Source:
    """Rows with what their columns are: the first is the id, named ones are attributes, the rest text fields."""

    rows: DataFrame
    doc_id: str
    fields: tuple[str, ...]
    attributes: tuple[str, ...]
    lang: str | None = None


def split(rows: DataFrame, attributes: tuple[str, ...] = (), language: str = LANGUAGE) -> Source:
    """The parts of a query's columns; unknown attributes raise SourceError."""
    cols = rows.columns
    if unknown := [a for a in attributes if a not in cols[1:]]:
        raise SourceError(f"attributes not in the query: {unknown}")
    lang = language if language in cols else None
    fields = tuple(c for c in cols[1:] if c not in attributes and c != lang)
    if not fields:
        raise SourceError("the query has no text field")
    return Source(rows, cols[0], fields, tuple(attributes), lang)


def sql_source(spark: SparkSession, query: str, attributes: tuple[str, ...] = ()) -> Source:
    """The rows of a SQL query over registered views."""
    return split(spark.sql(query), attributes)


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Temporary views of the Parquet tables of a folder."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def jdbc_source(spark: SparkSession, url: str, query: str, doc_id: str, low: int, high: int, parts: int, attributes: tuple[str, ...] = (), fetch: int = 10_000, **options: str) -> Source:
    """The rows of a database's query, read in ``parts`` ranges of the id side by side."""
    table = f"({query}) q"
    bounds = {"partitionColumn": doc_id, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts), "fetchsize": str(fetch)}
    return split(spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load(), attributes)


def id_ranges(low: int, high: int, size: int) -> list[tuple[int, int]]:
    """(first, last) of ranges of ``size`` ids that cover low to high."""
    return [(a, min(a + size - 1, high)) for a in range(low, high + 1, size)]


def in_range(rows: DataFrame, doc_id: str, first: int, last: int) -> DataFrame:
    """Rows with ids from first to last; the filter reaches the scan."""
    return rows.where(F.col(doc_id).between(first, last))


def in_ranges(rows: DataFrame, doc_id: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows with the number of the range of ids that they are in; ranges are of one size, as ``id_ranges`` gives them."""
    (low, last), high = ranges[0], ranges[-1][1]
    return in_range(rows, doc_id, low, high).withColumn("range_no", F.floor((F.col(doc_id) - low) / (last - low + 1)))


def share(rows: DataFrame, doc_id: str, parts: int, part: int, least: int | None = None) -> DataFrame:
    """One of ``parts`` parts of the rows by id modulo, from id ``least`` on."""
    out = rows.where(F.pmod(F.col(doc_id), F.lit(parts)) == part)
    return out if least is None else out.where(F.col(doc_id) >= least)


def newer(rows: DataFrame, doc_id: str, max_id: int | None) -> DataFrame:
    """Rows that an index up to ``max_id`` has not seen."""
    return rows if max_id is None else rows.where(F.col(doc_id) > max_id)


def problems(source: Source) -> list[str]:
    """Why a source cannot be indexed: id and attribute types, NULL or repeated ids, negative attributes; one pass over the rows."""
    kinds = {f.name: f.dataType for f in source.rows.schema.fields}
    out = [f"{c} is not a whole number" for c in (source.doc_id, *source.attributes) if not isinstance(kinds[c], _WHOLE)]
    if len(set(source.rows.columns)) < len(source.rows.columns):
        out.append("column names repeat")
    if out:
        return out
    i = F.col(source.doc_id)
    per_id = source.rows.groupBy(i.alias("i")).agg(F.count("*").alias("n"), *[F.min(a).alias(f"a{k}") for k, a in enumerate(source.attributes)])
    r = per_id.agg(F.max("n").alias("n"), F.min("i").alias("low"), F.count_if(F.col("i").isNull()).alias("nulls"), *[F.min(f"a{k}").alias(f"a{k}") for k in range(len(source.attributes))]).first()
    if r.nulls:
        out.append("ids are missing")
    if (r.n or 0) > 1:
        out.append("ids repeat")
    if (r.low or 0) < 0:
        out.append("ids are negative")
    return out + [f"{a} is negative" for k, a in enumerate(source.attributes) if (r[f"a{k}"] or 0) < 0]


def original_rows(hits: DataFrame, source: Source) -> DataFrame:
    """Hits with the columns of their source rows."""
    return hits.join(source.rows.withColumnRenamed(source.doc_id, "doc_id"), "doc_id")


def log_queries(rows: DataFrame, path: str) -> None:
    """Appends queries (query, results, searchmode, querytime, ip) to the log table, with the time."""
    rows.withColumn("timestamp", F.unix_timestamp()).write.mode("append").parquet(path)


def log_query(spark: SparkSession, path: str, query: str, results: int, mode: int, milliseconds: int, ip: str = "") -> None:
    """Appends one query to the log table."""
    log_queries(spark.createDataFrame([(query, results, mode, milliseconds, ip)], "query string, results long, searchmode int, querytime long, ip string").coalesce(1), path)

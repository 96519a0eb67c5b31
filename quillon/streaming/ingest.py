"""Documents that keep arriving, indexed by a streaming query.

Each micro-batch is written as a delta index of its own; a batch that is
replayed after a failure overwrites the same folder, so it counts once.  A
document that comes again counts with its newest batch only.  ``compact``
writes the finished batches as one, so that readers need not union them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..plans.catalog import exists, folders, is_folder, remove


def table(spark: SparkSession, path: str) -> DataFrame:
    """The stream of a Parquet table, be it a folder of files or a file of its own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a stream takes one file by a pattern only


def ingest(stream: DataFrame, settings: index.IndexSettings, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts indexing of the stream under ``path``; by default it ends when all that is there is done."""

    def batch(rows: DataFrame, n: int) -> None:
        index.write(rows, settings, f"{path}/batch={n:010d}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batch(path: str) -> int:
    """Last batch that a folder holds."""
    return int(path.rsplit("=", 1)[1])


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Folders of finished batches that no compacted one holds."""
    parts = [p for p in folders(spark, path) if exists(spark, f"{p}/docinfo/_SUCCESS")]
    whole = max((p for p in parts if "/upto=" in p), key=_batch, default=None)
    return [p for p in parts if "/batch=" in p and (whole is None or _batch(p) > _batch(whole))] + ([whole] if whole else [])


def _newest(spark: SparkSession, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings and docinfo of the batches; of a document in several those of the newest."""
    info = reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/docinfo").withColumn("_batch", F.lit(_batch(p))) for p in parts])
    post = reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/postings").withColumn("_batch", F.lit(_batch(p))) for p in parts])
    ids = info.groupBy("doc_id").agg(F.max("_batch").alias("_last"), F.countDistinct("_batch").alias("_n")).where("_n > 1").select("doc_id", "_last")

    def keep(df: DataFrame) -> DataFrame:  # documents that came again are few
        return df.join(ids, "doc_id", "left").where("_last IS NULL OR _last = _batch").drop("_batch", "_last")

    return keep(post), keep(info)


def read(spark: SparkSession, settings: index.IndexSettings, path: str) -> index.Index:
    """The index of all finished batches."""
    parts = _finished(spark, path)
    if len(parts) == 1:
        return index.read(spark, settings, *parts)
    post, info = _newest(spark, parts)
    words = index.with_metaphone(index.dictionary(post))
    return index.Index(settings, post, words, index.prefixes(words, settings.prefix_mode, settings.prefix_length, settings.analysis, settings.prefix_source), info, info.count())


def compact(spark: SparkSession, settings: index.IndexSettings, path: str) -> str:
    """Writes the finished batches as one folder and removes theirs; what arrives later stays beside it."""
    parts = _finished(spark, path)
    last = max(map(_batch, parts))
    target = f"{path}/upto={last:010d}"
    if len(parts) > 1 or parts[0] != target:
        post, info = _newest(spark, parts)
        index.write_tables(spark, settings, post, info, target)
        for p in parts:
            remove(spark, p)
    return target

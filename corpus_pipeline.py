"""A corpus pipeline of the library's operators, from raw documents to packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common, exact_dedup, language_id, mixing, packing, simhash_dedup

#: Every stage works on all that its predecessor kept; all but the last return the columns of ``documents``.
STAGES = [
    ("language ID", lambda spark, docs, sf_dir: language_id.accepted(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_dedup.dedup(docs)),
    ("SimHash near-dedup", lambda spark, docs, sf_dir: simhash_dedup.dedup(docs)),
    ("source mixing", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("best-fit packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: SQL can express neither the language models nor the trees.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again; a stage's input goes once its output is written."""
    out = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs

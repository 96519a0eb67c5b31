"""Named indexes in a folder: versions, deltas, merges, hidden documents.

An index is a folder with one sub-folder a version and one a delta, and a
manifest that names those in use.  A build writes new folders first and then
replaces the manifest, so readers see the old or the new index, never a part.
All access is through Hadoop's file systems, so the folder may be on any.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import Analysis
from ..operators import index as ix
from ..sources.tables import newer


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that all machines see: the session's ``spark.checkpoint.dir``; one of our own only where it runs on this machine alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tables-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    p, fs = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder."""
    p, fs = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Sub-folders of a folder, in order of name."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if there is one."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside and renames it over the old one in a step, so a reader finds either."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), options)


@dataclass(frozen=True)
class Manifest:
    """What an index consists of: the main version, its deltas, hidden documents, statistics.

    prefixes: folders with newer prefixes of a version or delta; stale: folders
    of the manifest before, kept for those that still read them.
    """

    name: str
    main: str | None = None
    deltas: tuple[str, ...] = ()
    disabled: str | None = None
    prefixes: dict = field(default_factory=dict)
    stale: tuple[str, ...] = ()
    documents: int = 0
    min_id: int | None = None
    max_id: int | None = None
    delta_documents: int = 0
    max_delta_id: int | None = None
    updated: int = 0
    settings: dict = field(default_factory=dict)


class CatalogError(ValueError):
    """A catalog request that cannot be met."""


def _settings(d: dict) -> ix.IndexSettings:
    d = dict(d)
    a = {k: tuple(v) if isinstance(v, list) else v for k, v in d.pop("analysis").items()}
    return ix.IndexSettings(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}, analysis=Analysis(**a))


class Catalog:
    """The indexes of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, name: str) -> str:
        return f"{self.path}/{name}/manifest.json"

    def _save(self, m: Manifest) -> Manifest:
        old = self.manifest(m.name) if exists(self.spark, self._manifest(m.name)) else m
        m = replace(m, updated=int(time.time()), prefixes={k: v for k, v in m.prefixes.items() if k in (m.main, *m.deltas)})
        m = replace(m, stale=tuple(sorted(self._used(old) - self._used(m))))
        _write_text(self.spark, self._manifest(m.name), json.dumps(asdict(m)))
        for p in set(old.stale) - self._used(m):  # two manifests ago: queries of the last one may still run
            remove(self.spark, p)
        return m

    @staticmethod
    def _used(m: Manifest) -> set[str]:
        """Folders that a manifest names."""
        return {p for p in (m.main, m.disabled, *m.deltas, *m.prefixes.values()) if p}

    def _version(self, name: str, kind: str) -> str:
        return f"{self.path}/{name}/{kind}-{uuid.uuid4().hex}"

    def names(self) -> list[str]:
        """Names of all indexes."""
        found = [p.rsplit("/", 1)[1] for p in folders(self.spark, self.path)]
        return [n for n in found if exists(self.spark, self._manifest(n))]

    def manifest(self, name: str) -> Manifest:
        """The manifest of an index."""
        if not exists(self.spark, self._manifest(name)):
            raise CatalogError(f"no index {name!r}")
        d = json.loads(_read_text(self.spark, self._manifest(name)))
        return Manifest(**{**d, "deltas": tuple(d["deltas"]), "stale": tuple(d.get("stale", ()))})

    def settings(self, name: str) -> ix.IndexSettings:
        """How an index is built."""
        return _settings(self.manifest(name).settings)

    def create(self, name: str, settings: ix.IndexSettings) -> Manifest:
        """An empty index; its name has 20 bytes at most and is new."""
        if not name or len(name.encode()) > 20 or "/" in name:
            raise CatalogError(f"not a name: {name!r}")
        if name in self.names():
            raise CatalogError(f"index {name!r} is there already")
        return self._save(Manifest(name, settings=asdict(settings)))

    def rebuild(self, name: str, docs: DataFrame) -> Manifest:
        """Builds a new main version from ``docs``; deltas go, the old version after the switch."""
        old = self.manifest(name)
        s, path = self.settings(name), self._version(name, "main")
        ix.write(docs, s, path)
        r = ix.statistics(docs, s.doc_id).first()
        return self._save(replace(old, main=path, deltas=(), documents=r.documents, min_id=r.min_id, max_id=r.max_id, delta_documents=0, max_delta_id=None))

    def add(self, name: str, docs: DataFrame) -> Manifest:
        """Indexes the rows that are newer than all before, as a delta; nothing new changes nothing."""
        old = self.manifest(name)
        s = self.settings(name)
        fresh = newer(docs, s.doc_id, max((i for i in (old.max_id, old.max_delta_id) if i is not None), default=None))
        r = ix.statistics(fresh, s.doc_id).first()
        if not r.documents:
            return old
        path = self._version(name, "delta")
        ix.write(fresh, s, path)
        return self._save(replace(old, deltas=(*old.deltas, path), delta_documents=old.delta_documents + r.documents, max_delta_id=r.max_id))

    def merge(self, name: str) -> Manifest:
        """One main version of the main version and its deltas, from their postings, without the source."""
        old = self.manifest(name)
        parts = [p for p in (old.main, *old.deltas) if p]
        if len(parts) < 2:
            return old
        s, path = self.settings(name), self._version(name, "main")
        both = ix.read(self.spark, s, *parts)
        ix.write_tables(self.spark, s, both.postings, both.docinfo, path)
        return self._save(replace(old, main=path, deltas=(), documents=old.documents + old.delta_documents, max_id=max(i for i in (old.max_id, old.max_delta_id) if i is not None), delta_documents=0, max_delta_id=None))

    def rebuild_prefixes(self, name: str) -> Manifest:
        """The prefixes of main version and deltas anew, from their dictionaries, in new folders."""
        m, s = self.manifest(name), self.settings(name)
        new = {p: self._version(name, "prefixes") for p in (m.main, *m.deltas) if p}
        for p, target in new.items():
            ix.write_prefixes(self.spark, s, p, target)
        return self._save(replace(m, prefixes=new))

    def disable(self, name: str, ids: DataFrame) -> Manifest:
        """Hides documents (doc_id) from searches."""
        old = self.manifest(name)
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"))
        if old.disabled:
            ids = ids.unionByName(self.spark.read.parquet(old.disabled))
        path = self._version(name, "disabled")
        ids.distinct().write.parquet(path)
        return self._save(replace(old, disabled=path))

    def enable_all(self, name: str) -> Manifest:
        """Shows all documents again."""
        old = self.manifest(name)
        return self._save(replace(old, disabled=None))

    def purge(self, name: str) -> Manifest:
        """The index without its documents."""
        old = self.manifest(name)
        return self._save(Manifest(name, settings=old.settings))

    def delete(self, name: str) -> None:
        """Removes an index."""
        self.manifest(name)
        remove(self.spark, f"{self.path}/{name}")

    def load(self, name: str) -> ix.Index:
        """The index, ready to search."""
        m = self.manifest(name)
        parts = [p for p in (m.main, *m.deltas) if p]
        if not parts:
            raise CatalogError(f"index {name!r} is empty")
        out = ix.read(self.spark, self.settings(name), *parts, prefixes=m.prefixes, documents=m.documents + m.delta_documents)
        return out.with_disabled(self.spark.read.parquet(m.disabled)) if m.disabled else out

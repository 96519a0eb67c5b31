"""Command line: create, build and search the indexes of a catalog folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.index import IndexSettings
from .operators.search import search
from .plans.catalog import Catalog
from .plans.query import Match, Rank, SearchOptions, Sort


def _pairs(values: list[str] | None) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for v in values or []:
        name, _, numbers = v.partition("=")
        out[name] = out.get(name, ()) + tuple(int(n) for n in numbers.split(","))
    return out


def parser() -> argparse.ArgumentParser:
    """Arguments of all commands."""
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("--catalog", required=True, help="folder of the indexes")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("purge", "delete", "merge", "rebuild-prefixes"):
        sub.add_parser(name).add_argument("index")
    c = sub.add_parser("create")
    c.add_argument("index")
    c.add_argument("--fields", required=True, help="comma-separated text columns")
    c.add_argument("--attributes", default="")
    c.add_argument("--doc-id", default="doc_id")
    c.add_argument("--prefix-mode", type=int, default=1)
    for name in ("build", "add"):
        b = sub.add_parser(name)
        b.add_argument("index")
        b.add_argument("parquet")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query")
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--matchmode", choices=[m.name.lower() for m in Match], default="all")
    s.add_argument("--rankingmode", choices=[m.name.lower() for m in Rank], default="proximity_bm25")
    s.add_argument("--sortmode", choices=[m.name.lower() for m in Sort], default="relevance")
    s.add_argument("--sortby")
    s.add_argument("--groupby")
    s.add_argument("--filterby", action="append", help="attribute=1,2 or !attribute=3")
    s.add_argument("--filterrange", action="append", help="attribute=low,high")
    return p


def options(a: argparse.Namespace) -> SearchOptions:
    """The search options of parsed arguments."""
    return SearchOptions(match=Match[a.matchmode.upper()], rank=Rank[a.rankingmode.upper()], sort=Sort[a.sortmode.upper()], sort_by=a.sortby, group_by=a.groupby, filters=_pairs(a.filterby), ranges={k: (v[0], v[1]) for k, v in _pairs(a.filterrange).items()})


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command and prints JSON lines."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    cat = Catalog(spark, a.catalog)
    if a.command == "list":
        for n in cat.names():
            print(json.dumps({"name": n, "documents": cat.manifest(n).documents}))
    elif a.command == "create":
        cat.create(a.index, IndexSettings(fields=tuple(a.fields.split(",")), attributes=tuple(x for x in a.attributes.split(",") if x), doc_id=a.doc_id, prefix_mode=a.prefix_mode))
    elif a.command in ("build", "add"):
        docs = spark.read.parquet(a.parquet)
        (cat.rebuild if a.command == "build" else cat.add)(a.index, docs)
    elif a.command == "search":
        for r in search(cat.load(a.index), a.query, options(a), a.offset, a.limit).hits.collect():
            print(json.dumps(r.asDict(), default=str))
    else:
        getattr(cat, a.command.replace("-", "_"))(a.index)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

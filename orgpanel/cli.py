"""Command line: ``python -m orgpanel.cli stat|fetch|parse|firms``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from orgpanel.plans import pipeline
from orgpanel.sources.fetch import fetch_many, manifest
from orgpanel.storage import clear_scratch


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="orgpanel")
    top.add_argument("--datadir", default=os.environ.get("ORGPANEL_DATADIR"))
    top.add_argument("--metadir", default=os.environ.get("ORGPANEL_METADIR"))
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("stat")
    fetch = verbs.add_parser("fetch")
    fetch.add_argument("kind")
    fetch.add_argument("--files")
    fetch.add_argument("--delay", type=float, default=10)
    parse = verbs.add_parser("parse")
    parse.add_argument("kind", choices=sorted(pipeline.PARSERS))
    parse.add_argument("files", nargs="*", help="files to parse; else all of --path that are not parsed yet")
    parse.add_argument("--path")
    parse.add_argument("--formats", nargs="*", type=int)
    firms = verbs.add_parser("firms")
    firms.add_argument("action", choices=sorted(pipeline.FIRMS))
    firms.add_argument("--sources", nargs="*")
    firms.add_argument("--compustat", action="store_true")
    for p in (fetch, parse):
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--dryrun", action="store_true")
    fetch.add_argument("--unzip", action="store_true")
    return top.parse_args(argv)


def main(argv: list[str] | None = None, spark=None) -> None:
    a = arguments(argv)
    if not a.datadir:
        sys.exit("a data folder is needed: --datadir or ORGPANEL_DATADIR")
    tables = f"{a.datadir}/tables"
    if a.verb == "stat":
        print(f"data: {a.datadir}\nlists: {a.metadir}")
    elif a.verb == "fetch":
        listed = a.files or f"{a.metadir}/{a.kind}_files.txt"
        fetch_many(manifest(listed), Path(a.datadir) / "raw" / a.kind, a.delay, a.dryrun, overwrite=a.overwrite, unzip=a.unzip)
    else:
        made = None
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("orgpanel").getOrCreate()
            made = spark
        if a.verb == "parse":
            pipeline.parse(spark, a.kind, a.files or a.path or f"{a.datadir}/raw/{a.kind}", tables, a.dryrun, a.overwrite, tuple(a.formats) if a.formats else None)
        elif a.action == "cluster":
            pipeline.cluster(spark, tables, a.sources)
        elif a.action == "merge":
            pipeline.merge(spark, tables, a.compustat)
        else:
            pipeline.FIRMS[a.action](spark, tables)
        if made:
            clear_scratch(made)


if __name__ == "__main__":
    main()

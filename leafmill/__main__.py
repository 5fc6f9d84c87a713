"""Command line: python -m leafmill list | run QUERY TABLES [--out PATH] [--show N] | explain QUERY TABLES."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from leafmill.plans import catalog
from leafmill.shipping import shipped


def parsed(words: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="leafmill", description="Runs the queries of the catalog.")
    actions = parser.add_subparsers(dest="action", required=True)
    actions.add_parser("list", help="names of all queries; * has SQL to be held against")
    for name, text in (("run", "runs a query on a folder of Parquet tables"), ("explain", "shows a query's plan")):
        one = actions.add_parser(name, help=text)
        one.add_argument("query", choices=sorted(catalog.QUERIES), metavar="QUERY")
        one.add_argument("tables")
        if name == "run":
            one.add_argument("--out", help="folder for the result, as Parquet; without it, rows are shown")
            one.add_argument("--show", type=int, default=20, metavar="N")
    return parser.parse_args(words)


def main(words: list[str], spark: SparkSession | None = None) -> int:
    told = parsed(words)
    if told.action == "list":
        print("\n".join(f"{name}{' *' if name in catalog.ORACLES else ''}" for name in sorted(catalog.QUERIES)))
        return 0
    own = spark or SparkSession.builder.appName("leafmill").getOrCreate()
    try:
        result = shipped(catalog.QUERIES[told.query])(own, told.tables)
        if told.action == "explain":
            result.explain("formatted")
        elif told.out:
            result.write.mode("errorifexists").parquet(told.out)
        else:
            result.show(told.show, truncate=80)
    finally:
        if spark is None:
            own.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

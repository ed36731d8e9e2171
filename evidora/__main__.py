"""Command line: `python -m evidora list`, `status`, `run QUERY SF_DIR [--out PATH --format csv]`."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evidora")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all registered queries")
    sub.add_parser("status", help="what is registered, and the tools")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--format", default="json", choices=["json", "csv", "parquet", "markdown"])
    args = parser.parse_args(argv)
    from . import catalog, registry

    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if args.command == "status":
        print(f"{len(catalog.QUERIES)} queries, {len(catalog.ORACLE_SQL)} with SQL")
        print(registry.describe(registry.tool_set("all")))
        return 0
    if args.query not in catalog.QUERIES:
        parser.error(f"no query {args.query}")
    from pyspark.sql import SparkSession

    from .sources import readers

    df = catalog.QUERIES[args.query](SparkSession.builder.getOrCreate(), args.sf_dir)
    if args.out:
        readers.write_table(df, args.out, args.format)
    else:
        df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

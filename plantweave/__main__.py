"""python -m plantweave [--module M] list | run QUERY DATA [OUT]: the registered queries from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .registry import queries


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plantweave")
    parser.add_argument("--module", action="append", default=[], help="a further module with registered queries")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="run a query over a folder of parquet tables")
    run.add_argument("query")
    run.add_argument("data")
    run.add_argument("out", nargs="?", help="a folder to write parquet to; without it rows are shown")
    given = parser.parse_args(argv)
    known = queries(given.module)
    if given.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if given.query not in known:
        parser.error(f"no query {given.query}")
    df = known[given.query](SparkSession.builder.getOrCreate(), given.data)
    if given.out:
        df.write.mode("overwrite").parquet(given.out)
    else:
        df.show(50, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

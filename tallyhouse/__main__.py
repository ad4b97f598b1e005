"""Command line: build a warehouse from a raw file, run its checks, run a named query.

    python -m tallyhouse build --csv lines.csv --root /shared/warehouse
    python -m tallyhouse check --root /shared/warehouse
    python -m tallyhouse query kpi_summary --root /shared/warehouse [--out /shared/kpi] [--days 2016-01-01 2016-12-31]
"""

import argparse
import sys

from pyspark.sql import SparkSession

from tallyhouse.catalogue import QUERIES
from tallyhouse.plans.quality import quality_report
from tallyhouse.plans.silver import DATE_FORMATS
from tallyhouse.plans.warehouse import QualityError, Warehouse


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyhouse")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="raw file to bronze, silver and gold tables")
    build.add_argument("--csv", required=True)
    build.add_argument("--lenient", action="store_true", help="set bad lines aside instead of failing")
    build.add_argument(
        "--date-format", action="append", help="of dates that are not ISO, as M/d/yyyy (the default) or dd.MM.yyyy; may be repeated"
    )
    check = commands.add_parser("check", help="constraints and reconciliations")
    query = commands.add_parser("query", help="run one named query")
    query.add_argument("name", choices=sorted(QUERIES))
    query.add_argument("--out", help="write parquet here instead of printing the first rows")
    query.add_argument("--days", nargs=2, metavar=("FIRST", "LAST"), help="only lines of these days, both included")
    for command in (build, check, query):
        command.add_argument("--root", required=True)
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName(f"tallyhouse {options.command}").getOrCreate()
    if options.command == "build":
        house = Warehouse.from_csv(
            spark, options.csv, options.root, options.lenient, options.date_format or DATE_FORMATS
        )
        try:
            house.build(check=True)
        except QualityError as error:
            print(error, file=sys.stderr)
            return 1
        return 0
    house = Warehouse.opened(spark, options.root)
    if options.command == "check":
        report = quality_report(house).orderBy("check")
        rows = report.collect()  # one row per check
        for row in rows:
            print(f"{'ok  ' if row.passed else 'FAIL'} {row['check']}: {row.actual} (expected {row.expected})")
        return 0 if all(row.passed for row in rows) else 1
    result = QUERIES[options.name](house.period(*options.days) if options.days else house)
    if options.out:
        result.write.mode("overwrite").parquet(options.out)
    else:
        result.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

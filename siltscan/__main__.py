"""Command line: ``python -m siltscan IMAGE -o FOLDER [--no-current-gen]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from siltscan.operators.report import summary
from siltscan.plans.recovery import run_recovery_engine


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltscan", description="Recover deleted data from a raw image.")
    parser.add_argument("image")
    parser.add_argument("--output", "-o", metavar="FOLDER", help="where to put what is recovered", default="recovered")
    parser.add_argument("--no-current-gen", help="leave current nodes alone", action="store_true")
    args = parser.parse_args(argv)
    # Looking up the caller of each column function would take longer than planning.
    spark = SparkSession.builder.appName("siltscan").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    try:
        tables = run_recovery_engine(spark, args.image, args.output, not args.no_current_gen)
    except FileNotFoundError:
        print(f"no such image: {args.image}", file=sys.stderr)
        return 1
    if "stats" not in tables:
        print("no valid superblock", file=sys.stderr)
        return 1
    print(summary(tables))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m folioscope convert IN OUT | transform IN OUT [--option value] | formats [TEXT]"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("convert", "transform"):
        one = commands.add_parser(name)
        one.add_argument("source")
        one.add_argument("target")
    drawing = commands.choices["transform"]
    for flag in ("minify", "responsive", "remove-metadata", "clean-paths", "strip-empty-groups"):
        drawing.add_argument(f"--{flag}", action="store_true")
    drawing.add_argument("--monochrome")
    drawing.add_argument("--precision", type=int)
    commands.add_parser("formats").add_argument("text", nargs="?", default="")
    given = parser.parse_args(argv)

    from . import api

    if given.command == "formats":
        for name, suffixes, written in api.catalogue(given.text):
            print(name, *suffixes, "(written too)" if written else "")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    if given.command == "convert":
        report = api.convert_path(spark, given.source, given.target)
    else:
        options = {k: v for k, v in vars(given).items() if k not in ("command", "source", "target") and v not in (None, False)}
        report = api.transform(spark, given.source, given.target, **options)
    failed = 0
    for row in report.toLocalIterator():
        print(*row)
        failed += bool(row.asDict().get("error"))
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())

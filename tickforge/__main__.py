"""python -m tickforge ticks SOURCE TARGET | book SOURCE TARGET [--symbol S] [--rth] [--quotes] | check NAME=PATH:TIME[:COLUMN,...] ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .sources import ticks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickforge", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ticks", "book"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
        if name == "ticks":
            p.add_argument("--threshold", type=float, default=3.0)
        else:
            p.add_argument("--symbol")
            p.add_argument("--rth", action="store_true")
            p.add_argument("--quotes", action="store_true")
    sub.add_parser("check").add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "ticks":
        out = ticks.prepare_ticks(spark, args.source, args.target, args.threshold)
    elif args.command == "book":
        out = ticks.prepare_book(spark, args.source, args.target, symbol=args.symbol, rth_only=args.rth, include_quotes=args.quotes)
    else:
        files = {}
        for f in args.files:
            name, _, rest = f.partition("=")
            path, at, *columns = rest.split(":")
            files[name] = (path, at, columns[0].split(",") if columns else [])
        out = ticks.check_files(spark, files)
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()

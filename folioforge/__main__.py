"""The command line: lookups over a folder of recorded answers, as text, JSON or CSV."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import filters
from folioforge.plans.run import recorded, run_to_end
from folioforge.sources import files, report


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="folioforge", description="Every edition of a book, by language, from its first appearance on.")
    parser.add_argument("folder", help="recorded answers, a Parquet table each")
    parser.add_argument("--year-from", type=int)
    parser.add_argument("--year-to", type=int)
    parser.add_argument("--publisher", help="only editions whose publisher contains this")
    parser.add_argument("--format", choices=["text", "json", "csv"], default="text")
    parser.add_argument("-o", "--output", help="a folder to write to (needed for csv)")
    parser.add_argument("--this-year", type=int, required=True)
    args = parser.parse_args(given)
    if args.format == "csv" and not args.output:
        parser.error("--format csv needs --output")
    return args


def kept(rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    return filters.keep(rows, F.col("year_num"), args.year_from, args.year_to, args.publisher)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    spark = SparkSession.builder.appName("folioforge").getOrCreate()
    frames = recorded(spark, args.folder)
    parts = run_to_end(frames, args.this_year)
    rows = kept(parts["rows"], args)
    if args.format == "text":
        shown = report.work_report(parts["headers"], parts["spans"], rows, parts["ledger"]).orderBy("lookup", "place").select("lookup", "line")
        if args.output:
            shown.select("line").write.mode("overwrite").text(args.output)
        else:
            for r in shown.toLocalIterator():
                print(r["line"])
        return
    asked = frames["questions"].select("lookup", F.col("title").alias("query_title"), F.col("author").alias("query_author"))
    if args.format == "csv":
        files.write_csv(files.flat(rows, asked, ["lookup"]), args.output)
    elif args.output:
        files.write_json(asked.join(rows, "lookup", "left"), args.output)
    else:
        for r in asked.join(rows, "lookup", "left").toJSON().toLocalIterator():
            print(r)
    print(f"{args.format} done", file=sys.stderr)


if __name__ == "__main__":
    main()

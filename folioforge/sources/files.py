"""Files in and out: lists of books to look up, and results as JSON, CSV and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "query_title query_author language title authors publisher year year_note isbn medium credited_to sources url"
).split()


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(title, author) of a text file: one ``Title | Author`` a line; ``#`` lines and blank ones are skipped."""
    line = F.trim("value")
    parts = F.split(line, r"\s*\|\s*")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return rows.select(F.trim(parts[0]).alias("title"), F.nullif(F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))), F.lit("")).alias("author"))


def flat(results: DataFrame, questions: DataFrame, on: list[str]) -> DataFrame:
    """The fixed columns of a CSV; lists joined, and one row for a question without results."""
    kinds = dict(results.dtypes)
    joined = questions.join(results, on, "left")
    note = F.nullif(F.concat_ws(" — ", "year_note.label", "year_note.shown"), F.lit(""))
    lists = {"authors": "; ", "sources": ", "}
    pick = lambda c: note if c == "year_note" and kinds.get(c, "").startswith("struct") else F.array_join(c, lists.get(c, "; ")) if kinds.get(c, "").startswith("array") else F.col(c).cast("string")
    return joined.select(*[pick(c).alias(c) if c in joined.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

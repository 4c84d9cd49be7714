"""Results as text: a work's header, spans and editions, an author's people or works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text


def edition_line(row: DataFrame) -> Column:
    """One edition: year, title, publisher, code and sources, as far as they are there."""
    year = F.coalesce(F.col("year"), F.lit("----"))
    printings = F.when(F.size("printings") > 1, F.concat(F.lit(" ("), F.array_join("printings", ", "), F.lit(")")))
    people = F.when(F.size("translators") > 0, F.concat(F.lit("trans. "), F.array_join(F.transform("translators", text.author_display), ", ")))
    code = F.when(F.col("isbn").isNotNull(), F.concat(F.lit("ISBN "), F.col("isbn")))
    return F.concat(year, F.coalesce(printings, F.lit("")), F.lit("  "), F.concat_ws(" · ", "title", "publisher", people, code, F.concat(F.lit("["), F.array_join("sources", ", "), F.lit("]"))))


def work_report(headers: DataFrame, spans: DataFrame, editions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(lookup, place, line): each lookup's report, in the order of its lines.

    headers: lookup, title, authors, origin, total_editions.  spans: lookup, language,
    name, place, editions, first_year, last_year.  editions: lookup, language, place,
    ...  ledger: lookup, line, n.
    """
    part = lambda df, kind, a, b, line: df.select("lookup", F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("at"), line.alias("line"))
    zero = F.lit(0)
    title = F.concat(F.col("title"), F.when(F.size("authors") > 0, F.concat(F.lit(" / "), F.array_join("authors", ", "))).otherwise(""))
    count = F.concat(F.col("total_editions").cast("string"), F.when(F.col("total_editions") == 1, " edition").otherwise(" editions"))
    years = F.when(F.col("first_year").isNull(), "undated").when(F.col("first_year") == F.col("last_year"), F.col("first_year").cast("string")).otherwise(F.concat_ws("-", F.col("first_year").cast("string"), F.col("last_year").cast("string")))
    span = F.concat(F.lit("  "), F.col("name"), F.lit(": "), F.col("editions").cast("string"), F.lit(", "), years)
    listed = editions.join(spans.select("lookup", "language", F.col("place").alias("span")), ["lookup", "language"])
    lines = part(headers, 0, zero, zero, title).unionByName(part(headers.where("origin <> ''"), 1, zero, zero, F.col("origin"))).unionByName(part(headers, 2, zero, zero, count))
    lines = lines.unionByName(part(spans, 3, F.col("place"), zero, span)).unionByName(part(listed, 4, F.col("span"), F.col("place"), F.concat(F.lit("    "), edition_line(listed))))
    lines = lines.unionByName(part(ledger, 5, -F.col("n"), zero, F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(" "), F.col("line"))))
    return lines.withColumnRenamed("at", "place")


def author_report(works: DataFrame, people: DataFrame) -> DataFrame:
    """(author, place, line): the people offered, or the works listed (author, list, place, title, year)."""
    line = F.concat_ws("  ", F.coalesce(F.col("year").cast("string"), F.lit("----")), "title")
    group = F.when(F.col("list") == "works", 1).otherwise(2)
    offered = people.select("author", F.struct(F.lit(0).alias("kind"), F.col("place").cast("long").alias("a")).alias("place"), F.concat_ws("  ", "id", "heading").alias("line"))
    return works.select("author", F.struct(group.alias("kind"), F.col("place").cast("long").alias("a")).alias("place"), line.alias("line")).unionByName(offered)

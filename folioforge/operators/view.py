"""The derived view: groups, spans, facets, header, bands and the coverage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(editions: DataFrame, original_language: str | None = None, original_year: int | None = None) -> DataFrame:
    """Per language: editions, first and last year, whether it holds the original, and the place in the list.

    Order: unknown last, undated last, first year, editions (most first), code.
    """
    year = F.col("year").cast("int")
    g = editions.groupBy("language").agg(F.count("*").alias("editions"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    held = F.coalesce((F.col("language") == F.lit(original_language)) & F.lit(original_year).between(F.col("first_year"), F.col("last_year")), F.lit(False))
    order = Window.orderBy(F.col("language") == "unknown", F.col("first_year").isNull(), "first_year", F.desc("editions"), "language")
    return g.withColumn("is_original", held).withColumn("place", F.row_number().over(order))


def facets(editions: DataFrame, key: str, label: str) -> DataFrame:
    """(key, editions, label): the commonest spelling, then the shortest, then the first in the alphabet."""
    n = editions.groupBy(key, label).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.length(label), label)
    total = Window.partitionBy(key)
    return n.withColumn("place", F.row_number().over(order)).withColumn("editions", F.sum("n").over(total)).where("place = 1").select(key, "editions", F.col(label).alias("label"))


def earliest(editions: DataFrame, group: str, original_year: str, original_language: str) -> DataFrame:
    """Per group the earliest year not before the original, its languages, the lead row and how many older rows were left out.

    A group of which all dated rows are older has no year, but their number.
    """
    old = F.col("year") < F.col(original_year)
    dated = editions.where(F.col("year").isNotNull()).withColumn("old", F.coalesce(old, F.lit(False)))
    first = dated.groupBy(group).agg(F.min(F.when(~F.col("old"), F.col("year"))).alias("first"), F.sum(F.col("old").cast("int")).cast("long").alias("older_dropped"))
    at = dated.join(first, group).where(~F.col("old") & (F.col("year") == F.col("first")))
    own = F.coalesce(F.col("language") == F.col(original_language), F.lit(False))
    lead = at.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.min_by("seq", F.struct(~own, "seq")).alias("lead_seq"))
    return first.withColumnRenamed("first", "year").join(lead, group, "left")


def choices(editions: DataFrame, lookup: str, group: str, title: str, year: str) -> DataFrame:
    """A lookup's books to choose from, if there are two or more: editions, commonest title, first and last year."""
    g = editions.groupBy(lookup, group).agg(F.count("*").alias("editions"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    n = editions.where(F.col(title).isNotNull()).groupBy(lookup, group, title).agg(F.count("*").alias("n"))
    named = n.groupBy(lookup, group).agg(F.min_by(title, F.struct(-F.col("n"), title)).alias(title))
    out = g.join(named, [lookup, group])
    return out.withColumn("books", F.count("*").over(Window.partitionBy(lookup))).where("books > 1").drop("books")


def ledger_lines(coverage: DataFrame, lines: dict[str, str], rest: str = "other") -> DataFrame:
    """(line, n) of (value, n) counts by a mapping; what the mapping doesn't name is one remainder line."""
    line = F.lit(rest)
    for value, name in lines.items():
        line = F.when(F.col("value") == value, name).otherwise(line)
    return coverage.groupBy(line.alias("line")).agg(F.sum("n").alias("n"))


def row_note(records: DataFrame, group: str, note: str, severity: list[str]) -> DataFrame:
    """The least certain note of each group."""
    rank = F.nullif(F.array_position(F.array(*[F.lit(x) for x in severity]), F.col(note)), F.lit(0))
    return records.groupBy(group).agg(F.min_by(note, rank).alias(note))


def also_filed_as(records: DataFrame, key: str, language: str) -> DataFrame:
    """(key, languages) of keys that are filed under several languages."""
    g = records.groupBy(key).agg(F.sort_array(F.collect_set(language)).alias("languages"))
    return g.where(F.size("languages") > 1)


def header_authors(records: DataFrame, group: str, authors: str, seq: str) -> DataFrame:
    """The first three distinct names of the first record that has any."""
    has = F.size(authors) > 0
    return records.groupBy(group).agg(F.slice(F.array_distinct(F.min_by(F.when(has, F.col(authors)), F.when(has, F.col(seq)))), 1, 3).alias("authors"))

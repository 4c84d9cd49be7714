"""Row filters with a reason for each hidden row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def why(language: Column, years: Column, publishers: Column, languages: list[str] | None, low: int | None, high: int | None, wanted: list[str] | None) -> Column:
    """The first reason a row is hidden: no-language, other-language, no-year, outside-years, other-publisher; null if shown."""
    out = F.lit(None).cast("string")
    if wanted:
        out = F.when(~F.coalesce(F.arrays_overlap(publishers, F.array(*[F.lit(x) for x in wanted])), F.lit(False)), "other-publisher").otherwise(out)
    if low is not None or high is not None:
        inside = F.exists(years, lambda y: (y >= (low if low is not None else -(10**9))) & (y <= (high if high is not None else 10**9)))
        out = F.when(F.coalesce(F.size(years), F.lit(0)) <= 0, "no-year").when(~inside, "outside-years").otherwise(out)
    if languages:
        out = F.when(F.coalesce(language, F.lit("unknown")) == "unknown", "no-language").when(~language.isin(languages), "other-language").otherwise(out)
    return out


def apply(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(shown rows, hidden counts by reason); the reasons' counts sum to what is hidden."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("hidden"))


def keep(rows: DataFrame, year: Column, low: int | None = None, high: int | None = None, publisher: str | None = None) -> DataFrame:
    """Years in range (no year fails a range) and a publisher that contains the text, case aside."""
    out = rows
    if low is not None:
        out = out.where(year >= low)
    if high is not None:
        out = out.where(year <= high)
    return out.where(F.lower("publisher").contains(publisher.lower())) if publisher else out

"""The request ledger: causes of slowness, failures and truncations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slow_causes(calls: DataFrame, slow_after: float = 10.0) -> DataFrame:
    """Per source: requests, seconds, failed and slow answers, most seconds first."""
    slow = F.col("seconds") - F.coalesce("waited", F.lit(0.0)) > slow_after
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return calls.groupBy("source").agg(
        F.count("*").alias("requests"), F.sum("seconds").alias("seconds"), count(F.col("error").isNotNull()).alias("failed"), count(slow).alias("slow"),
    ).orderBy(F.desc("seconds"), "source")


def source_states(states: DataFrame, failed: DataFrame) -> DataFrame:
    """(source, state): ok with failed requests is 'partial (n failed)'; worse states stay."""
    n = F.coalesce("failed", F.lit(0))
    partial = F.concat(F.lit("partial ("), n.cast("string"), F.lit(" failed)"))
    return states.join(failed.select("source", "failed"), "source", "left").select("source", F.when((F.col("state") == "ok") & (n > 0), partial).otherwise(F.col("state")).alias("state"))


def values_to_ask(facet: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, facet_n, record_n): values whose counts differ, most different first."""
    both = facet.toDF(key, "facet_n").join(records.toDF(key, "record_n"), key, "full")
    out = both.select(key, F.coalesce("facet_n", F.lit(0)).alias("facet_n"), F.coalesce("record_n", F.lit(0)).alias("record_n")).where("facet_n <> record_n")
    return out.orderBy(F.desc(F.abs(F.col("facet_n") - F.col("record_n"))), key)


def contradicted(records: DataFrame, answers: DataFrame, id_: str, year: str) -> DataFrame:
    """Records that the index files under years, none of which is their own."""
    filed = records.join(answers.select(id_, F.col(year).alias("filed")), id_)
    right = filed.where(F.col(year) == F.col("filed")).select(id_)
    return filed.join(right, id_, "left_anti").groupBy(id_, year).agg(F.array_join(F.sort_array(F.collect_set(F.col("filed").cast("string"))), ",").alias("filed"))


def reason(*tests: tuple[Column, str]) -> Column:
    """The first reason that holds; null if none does."""
    out = F.lit(None).cast("string")
    for test, name in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out

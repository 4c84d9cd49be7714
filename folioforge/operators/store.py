"""The keyed store: sightings to records, first sighting first, gaps filled by later ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(c: Column, kind: str) -> Column:
    return F.size(c) > 0 if kind.startswith("array") else F.coalesce(c.cast("string"), F.lit("")) != ""


def first_of(c: str, seq: str, when: Column) -> Column:
    return F.min_by(F.when(when, F.col(c)), F.when(when, F.col(seq)))


def united(rows: DataFrame, keys: Sequence[str], c: str, seq: str) -> DataFrame:
    """(keys, c): the items of an array column over the rows of a key in arrival order, each once.

    Items are made distinct before they are collected, so a key with very many rows is small.
    """
    each = rows.select(*keys, F.col(seq).alias("__s"), F.posexplode(c).alias("__p", "__v"))
    first = each.groupBy(*keys, "__v").agg(F.min(F.struct("__s", "__p")).alias("__at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]).alias(c))


def with_united(out: DataFrame, rows: DataFrame, keys: Sequence[str], lists: Sequence[str], seq: str) -> DataFrame:
    """``out`` (one row a key) with the united arrays; empty where a key has none."""
    kinds = dict(rows.dtypes)
    for c in lists:
        more = united(rows, keys, c, seq).withColumnsRenamed({k: f"__{k}" for k in keys})
        on = [out[k].eqNullSafe(more[f"__{k}"]) for k in keys]
        out = out.join(more, on, "left").drop(*[f"__{k}" for k in keys]).withColumn(c, F.coalesce(c, F.array().cast(kinds[c])))
    return out


def upsert(
    sightings: DataFrame, keys: Sequence[str], seq: str = "seq", scalars: Sequence[str] = (), lists: Sequence[str] = (),
    provenance: Sequence[str] = (), refused: str | None = None,
) -> DataFrame:
    """One row a key: scalars from the first sighting that has one, lists united in order.

    Provenance columns come from the first admitted sighting, else from the first;
    ``routes`` counts sightings.  Order-free given ``seq``: batches may come in any order.
    """
    kinds = dict(sightings.dtypes)
    any_ = F.lit(True)
    admitted = ~F.col(refused) if refused else any_
    aggs = [first_of(c, seq, present(F.col(c), kinds[c])).alias(c) for c in scalars]
    aggs += [F.coalesce(first_of(c, seq, admitted), first_of(c, seq, any_)).alias(c) for c in provenance]
    if refused:
        aggs.append(F.bool_and(refused).alias(refused))
    return with_united(sightings.groupBy(*keys).agg(F.min(seq).alias(seq), F.count("*").alias("routes"), *aggs), sightings, keys, lists, seq)


def coverage(sightings: DataFrame, records: DataFrame, dimensions: dict[str, str], refused: str) -> DataFrame:
    """(dimension, value, n): records by source and evidence, sightings by route, admitted and refused."""
    parts = []
    for name, column in dimensions.items():
        table = sightings if name == "route" else records
        parts.append(table.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n"))
    state = records.groupBy(F.when(F.col(refused), "refused").otherwise("admitted").alias("value")).agg(F.count("*").alias("n"))
    out = state.select(F.lit("state").alias("dimension"), "value", "n")
    for p in parts:
        out = out.unionByName(p)
    return out


def attach_dates(records: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index answers (date_indexed, date_check_failed) on the records held; null stays 'never asked'."""
    return records.drop("date_indexed", "date_check_failed").join(answers, list(keys), "left")


def merge_states(states: DataFrame, stage: str = "stage_no") -> DataFrame:
    """(source, state): the first state that isn't ok, else ok."""
    bad = F.col("state") != "ok"
    return states.groupBy("source").agg(F.coalesce(first_of("state", stage, bad), F.lit("ok")).alias("state"))

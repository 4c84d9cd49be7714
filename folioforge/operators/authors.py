"""An author's works of several sources: joined by title, the rest kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.simjoin import best, title_join


def join_sources(works: DataFrame, items: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, band): works joined to items, then docs joined to the rows of both.

    Each side: key and the token columns of ``with_tokens``.  A work without one best
    item is a row of its own; docs that tie or match nothing make the band.
    """
    to_item = best(title_join(works, items, "key", "key")).select(F.col("l").alias("key"), F.col("r").alias("item"))
    rows = works.join(to_item, "key", "left").withColumn("row", F.coalesce(F.concat(F.lit("item:"), "item"), F.concat(F.lit("work:"), F.col("key"))))
    names = rows.select("row", "full", "core", "plain", "core_plain").unionByName(items.select(F.concat(F.lit("item:"), "key").alias("row"), "full", "core", "plain", "core_plain"))
    named = names.dropDuplicates(["row", "plain"]).withColumn("name", F.concat_ws("|", "row", "plain"))
    score = title_join(docs, named, "key", "name").join(named.select(F.col("name").alias("r"), "row"), "r").groupBy("l", "row").agg(F.max("score").alias("score"))
    docs_in = best(score.withColumnRenamed("row", "r")).select(F.col("l").alias("key"), F.col("r").alias("row"))
    held = rows.select("row", F.col("key").alias("work"), F.lit(None).cast("string").alias("doc")).unionByName(docs_in.select("row", F.lit(None).cast("string").alias("work"), F.col("key").alias("doc")))
    every = items.select(F.concat(F.lit("item:"), "key").alias("row"), F.lit(None).cast("string").alias("work"), F.lit(None).cast("string").alias("doc"))
    out = held.unionByName(every).groupBy("row").agg(F.count("work").alias("works"), F.count("doc").alias("docs"))
    return out, docs.join(docs_in, "key", "left_anti")


def unlinked(records: DataFrame, linked: DataFrame, joined: DataFrame, id_: str, title: Column) -> DataFrame:
    """(title, records): records not linked and joining no work, by core title."""
    left = records.join(linked.select(id_).distinct(), id_, "left_anti").join(joined.select(id_).distinct(), id_, "left_anti")
    return left.groupBy(F.lower(title).alias("title")).agg(F.count("*").alias("records"))


def sort_rows(rows: DataFrame, year: str, title: str, key: str) -> DataFrame:
    return rows.orderBy(F.col(year).desc_nulls_last(), F.lower(title), key)


def candidates(answers: DataFrame, person: str, form: str, pos: str) -> DataFrame:
    """People reached by any form of a name, with the forms in the order asked."""
    forms = F.transform(F.array_sort(F.collect_set(F.struct(pos, form))), lambda x: x[form])
    return answers.groupBy(person).agg(forms.alias("forms"), F.count("*").alias("hits"))


def first_spelling(rows: DataFrame, token_key: str, pos: str) -> DataFrame:
    """The first spelling of each token set."""
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(token_key).orderBy(pos))).where("__p = 1").drop("__p")


def extra_years(facet: DataFrame, floor: int, ceiling: int) -> DataFrame:
    """(year): years a capped facet doesn't list: gaps from the newest on, then below, then above."""
    got = facet.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.collect_set("year").alias("ys"))
    gaps = F.array_except(F.sequence(F.col("hi"), F.col("lo"), F.lit(-1)), F.col("ys"))
    below = F.when(F.col("lo") > floor, F.sequence(F.col("lo") - 1, F.lit(floor), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    above = F.when(F.col("hi") < ceiling, F.sequence(F.col("hi") + 1, F.lit(ceiling))).otherwise(F.array().cast("array<int>"))
    return got.select(F.posexplode(F.concat(gaps, below, above)).alias("pos", "year"))

"""Catalogue records made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import isbn
from folioforge.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def isbn_of(key) -> F.Column:
    first = F.concat(F.lit("978"), F.lpad(key.cast("string"), 9, "0"))
    return F.concat(first, isbn.check13(first))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id, title, isbn, language, publisher, year, medium, pages of each order line.

    Dimensions are joined with what the optimiser chooses; ``lineitem`` is scanned for seven columns.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", isbn_of(F.col("p_partkey")).alias("code"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.when(F.col("l_linenumber") % 2 == 1, "SBN").otherwise("Open Library").alias("source"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("p_name").alias("title"), F.when(F.col("l_linenumber") == 4, None).otherwise(F.col("code")).alias("isbn"),
        F.col("n_name").alias("language"), F.col("p_brand").alias("publisher"), F.year("l_shipdate").alias("year"),
        F.col("p_type").alias("medium"), F.col("l_quantity").cast("int").alias("pages"), F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("lookup"),
    )


#: The same records for DuckDB.
SQL = """
codes AS (
  SELECT p_partkey, p_name, p_brand, p_type, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS f FROM part
), parts AS (
  SELECT *, f || ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(f, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10)::VARCHAR AS code FROM codes
), rec AS (
  SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'SBN' ELSE 'Open Library' END AS source,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, p_name AS title,
    CASE WHEN l_linenumber = 4 THEN NULL ELSE code END AS isbn, n_name AS language, p_brand AS publisher,
    year(l_shipdate)::INT AS year, p_type AS medium, l_quantity::INT AS pages, l_partkey AS work, l_orderkey AS lookup
  FROM lineitem JOIN parts ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)
"""

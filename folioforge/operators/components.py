"""Connected components: records that share a key, and sets that contain each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.scratch import discard, written


def min_label(edges: DataFrame) -> DataFrame:
    """(node, label) for undirected ``edges`` (a, b): the least node of the component.

    Each round takes the least label among neighbours and then the label's own label
    (pointer jumping), so the rounds grow with the logarithm of a chain's length.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    held = None
    while True:
        labels = written(labels)
        if held is not None:
            discard(held)
        near = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.toDF("low", "up")
        new = written(low.join(up, "low", "left").select("node", "label", F.least("low", F.coalesce("up", "low")).alias("new")))
        if new.where("new <> label").isEmpty():
            discard(new, both)
            return labels
        discard(labels)
        held, labels = new, new.select("node", F.col("new").alias("label"))


def by_shared_key(rows: DataFrame, node: str, key: str) -> DataFrame:
    """(node, label): rows that share any key, directly or through others; the label is the least key.

    The graph is bipartite, nodes and keys; keys join each other through a node's least key.
    """
    pairs = rows.where(F.col(key).isNotNull()).select(F.col(node).alias("node"), F.col(key).alias("key")).distinct()
    least = pairs.groupBy("node").agg(F.min("key").alias("least"))
    edges = pairs.join(least, "node").select(F.col("least").alias("a"), F.col("key").alias("b"))
    labels = min_label(edges)
    return least.join(labels.withColumnRenamed("node", "least"), "least").select("node", "label")


def containment_pairs(sets: DataFrame, key: str, tokens: str) -> DataFrame:
    """(a, b): rows of which a's token set (distinct tokens) is contained in b's, found at a's rarest token."""
    t = sets.where(F.size(tokens) > 0).select(F.col(key).alias("a"), F.col(tokens).alias("t"))
    each = t.select("a", "t", F.explode("t").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    rare = each.join(often, "token").groupBy("a").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("t").alias("t"))
    other = each.select("token", F.col("a").alias("b"), F.col("t").alias("u"))
    return rare.join(other, "token").where((F.col("a") != F.col("b")) & (F.size(F.array_except("t", "u")) == 0)).select("a", "b")


def containment_groups(rows: DataFrame, node: str, tokens: str) -> DataFrame:
    """(node, group): components of rows of which one's token set contains the other's.

    Equal sets are one set first.  A set is contained in another only if its rarest
    token is in the other, so each set looks for supersets at that one token.
    """
    t = rows.where(F.size(tokens) > 0).select(F.col(node).alias("node"), F.array_sort(F.array_distinct(tokens)).alias("t"))
    t = t.withColumn("set", F.array_join("t", " "))
    sets = t.select("set", "t").distinct()
    pairs = containment_pairs(sets, "set", "t")
    labels = min_label(pairs.union(sets.select("set", "set")))
    words = labels.withColumnRenamed("node", "set").join(sets, "set").select("label", "set", F.explode("t").alias("w"))
    key = words.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("group"))
    return t.join(labels.withColumnRenamed("node", "set"), "set").join(key, "label").select("node", "group")

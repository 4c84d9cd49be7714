"""Gates: who and what is admitted, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import GATE

# Media that aren't books, and media of text.
NON_BOOK_MEDIA = [
    "documento da proiettare o video", "musica manoscritta", "musica a stampa", "materiale cartografico a stampa",
    "manoscritto cartografico", "grafica",
]
TEXT_MEDIA = ["testo a stampa", "testo manoscritto"]


def tier(a: Column, b: Column) -> Column:
    """strong, weak, rejected or 'no work' of title affinity ``a`` and share ``b``."""
    return (
        F.when(a.isNull(), "no work").when((a >= GATE) | F.coalesce(b > 0.5, F.lit(False)), "strong")
        .when(F.coalesce(b == 0.5, F.lit(False)), "weak").otherwise("rejected")
    )


def accepted(tier_: Column, second_signal: Column) -> Column:
    return (tier_ == "strong") | (tier_.isin("weak", "rejected") & second_signal)


def share_b(query: DataFrame, work: DataFrame, group: str, id_: str, matched: Column) -> DataFrame:
    """(group, matched, filed, share): how many title-matching query rows are also filed under the work."""
    hits = query.where(matched).select(group, id_).distinct()
    filed = hits.join(work.select(group, id_).distinct(), [group, id_], "left_semi").groupBy(group).agg(F.count("*").alias("filed"))
    total = query.select(group).distinct().join(hits.groupBy(group).agg(F.count("*").alias("matched")), group, "left")
    out = total.join(filed, group, "left").select(group, F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("filed", F.lit(0)).alias("filed"))
    return out.withColumn("share", F.when(F.col("matched") > 0, F.col("filed") / F.col("matched")))


def identifies(linked: Column, isbn_matched: Column, affinity: Column) -> Column:
    """Why a record is strong: its authority link, its ISBN or its title; null if it isn't."""
    return F.when(linked, "uniform title").when(isbn_matched, "isbn").when(affinity >= GATE, "title match")


def is_book_medium(medium: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(medium, F.lit("")))).isin(NON_BOOK_MEDIA)


def is_text_medium(medium: Column) -> Column:
    return F.coalesce(medium, F.lit("")).isin("") | F.lower(F.trim(medium)).isin(TEXT_MEDIA)


def title_test(pairs: DataFrame) -> DataFrame:
    """(l, score, form) of pairs (l, score, form): the best score; equal scores take the greatest form."""
    return pairs.groupBy("l").agg(F.max(F.struct("score", "form")).alias("m")).select("l", "m.score", "m.form")


def pick_first(rows: DataFrame, group: str, count: str, pos: str) -> DataFrame:
    """The highest count of each group, the first on ties, with ``tied`` the number that share it."""
    by = Window.partitionBy(group)
    top = rows.withColumn("place", F.row_number().over(by.orderBy(F.desc(count), pos))).withColumn("r", F.rank().over(by.orderBy(F.desc(count))))
    return top.withColumn("tied", F.sum(F.when(F.col("r") == 1, 1).otherwise(0)).over(by)).where("place = 1").drop("place", "r")


def adopted_book(books: DataFrame, ask: str, n_sources: str, n_editions: str) -> DataFrame:
    """The only book of a question, or the only one of two sources where all others are single records."""
    by = Window.partitionBy(ask)
    several = F.when(F.col(n_sources) >= 2, 1).otherwise(0)
    others = F.when((F.col(n_sources) < 2) & (F.col(n_editions) > 1), 1).otherwise(0)
    w = books.withColumns({"books": F.count("*").over(by), "several": F.sum(several).over(by), "odd": F.sum(others).over(by)})
    keep = (F.col("books") == 1) | (F.col("several") == 1) & (F.col("odd") == 0) & (F.col(n_sources) >= 2)
    return w.where(keep).drop("books", "several", "odd")


def duplicate_works(docs: DataFrame, main: DataFrame, key: str, editions: str, title: str, pos: str) -> DataFrame:
    """Works beside the main ones: first of each key, by editions, title and key."""
    left = docs.join(main.select(key).distinct(), key, "left_anti")
    once = left.withColumn("p", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("p = 1").drop("p")
    return once.orderBy(F.desc(editions), F.lower(title), key)

"""An author's works as rows: what each source states of a work, its title, its year and what to look it up by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.functions.text import GATE, is_latin
from folioforge.operators.evidence import FACET_CAP, medium_of


def catalogued_title(raw: Column) -> Column:
    return text.title_of(F.coalesce(raw, F.lit("")))


def works_union(facets: DataFrame) -> DataFrame:
    """(author, value, label): the first label of each value over all facets read.

    Rows: author, pos, value, label.
    """
    named = facets.where(F.coalesce("value", F.lit("")) != "").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "value"))
    return named.groupBy("author", "value").agg(F.min_by("label", "pos").alias("label"))


def best_work(pairs: DataFrame, names: DataFrame, same: DataFrame, parts: DataFrame) -> DataFrame:
    """(l, r): the item that a uniform title joins.

    pairs: l, r, score of candidates at the gate.  One best item joins; several do if they
    are one work, each pair of them agreeing wholly (``same``: a, b, both ways) and none a
    part of another (``parts``: part, whole): then the one of most names (``names``: r, n),
    ties to the least key.
    """
    top = pairs.withColumn("place", F.rank().over(Window.partitionBy("l").orderBy(F.desc("score")))).where((F.col("place") == 1) & (F.col("score") >= GATE)).select("l", "r")
    size = top.groupBy("l").agg(F.count("*").alias("n"))
    sole = top.join(size.where("n = 1").select("l"), "l")
    several = top.join(size.where("n > 1"), "l")
    linked = several.join(same.select(F.col("a").alias("r"), F.col("b").alias("r2")), "r").join(top.select("l", F.col("r").alias("r2")), ["l", "r2"], "left_semi")
    whole = linked.where("r <> r2").groupBy("l").agg(F.count_distinct("r", "r2").alias("pairs")).join(size, "l").where(F.col("pairs") == F.col("n") * (F.col("n") - 1)).select("l")
    nested = several.join(parts.select(F.col("part").alias("r"), "whole"), "r").join(top.select("l", F.col("r").alias("whole")), ["l", "whole"], "left_semi").select("l").distinct()
    one = several.join(whole, "l", "left_semi").join(nested, "l", "left_anti").join(names, "r")
    most = one.groupBy("l").agg(F.min_by("r", F.struct(-names["n"], "r")).alias("r"))
    return sole.select("l", "r").unionByName(most)


def joins_any(pairs: DataFrame) -> DataFrame:
    """Left keys that agree with any candidate at the gate."""
    return pairs.where(F.col("score") >= GATE).select("l").distinct()


def derived_entry(label: Column, title: Column, years: Column, records: Column) -> Column:
    """An adaptation: its title, medium, the year its qualifier states, else the earliest, and its records."""
    stated = F.nullif(F.regexp_extract(label, r"<[^>]*?[;,]\s*(\d{4})", 1), F.lit("")).cast("int")
    series = F.regexp_extract(title, r"^\{([^}]+)\}", 1)
    shown = F.when(series != "", series).otherwise(title)
    shown = F.concat(F.upper(F.substring(shown, 1, 1)), F.substring(shown, 2, 1 << 30))
    return F.struct(shown.alias("title"), medium_of(label).alias("medium"), F.coalesce(stated, F.array_min(years)).alias("year"), stated.isNotNull().alias("stated"), records.alias("records"))


def earliest_year(sbn_years: Column, doc_years: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.array_min(F.array_compact(F.concat(F.coalesce(sbn_years, none), F.coalesce(doc_years, none))))


def row_year(original: Column, earliest: Column) -> Column:
    """struct(year, kind): the original year, else the earliest found."""
    return F.struct(F.coalesce(original, earliest).alias("year"), F.when(original.isNotNull(), "original").when(earliest.isNotNull(), "earliest").alias("kind"))


def matched_titles(titles: Column, derived_titles: Column) -> Column:
    """What a record is joined on: the book's titles, then its adaptations'."""
    return F.concat(titles, F.flatten(derived_titles))


def capital(title: Column) -> Column:
    return F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 1 << 30))


def display_title(original: Column, uniform_titles: Column, scored: Column, titles: Column, key: Column) -> Column:
    """The original's title; else the catalogued title closest to the uniform one; else that, cleaned; else any title; else the key.

    ``scored``: array of struct(score, title) of the row's other titles against the
    cleaned uniform title; equal scores take the greatest title.
    """
    label = text.clean_label(uniform_titles[0])
    near = F.array_max(scored)
    by_label = F.when(near["score"] >= GATE, near["title"]).otherwise(capital(label))
    return F.when(F.coalesce(original, F.lit("")) != "", original).when(F.size(uniform_titles) > 0, by_label).otherwise(F.coalesce(F.try_element_at(titles, F.lit(1)), key))


def latin_of(titles: Column) -> Column:
    return F.filter(titles, lambda t: (F.coalesce(t, F.lit("")) != "") & is_latin(t))


def lookup_title(original: Column, uniform_titles: Column, titles: Column, title: Column) -> Column:
    """The first Latin title of original, uniform and other titles; else the row's own."""
    cleaned = F.transform(uniform_titles, text.clean_label)
    return F.coalesce(F.try_element_at(latin_of(F.concat(F.array(original), cleaned, titles)), F.lit(1)), title)


def lookup_variants(uniform_titles: Column, item_forms: Column, sent: Column) -> Column:
    """Other Latin spellings to look a work up by, each once."""
    cleaned = F.transform(uniform_titles, text.clean_label)
    return F.array_distinct(F.filter(latin_of(F.concat(cleaned, item_forms)), lambda t: t != sent))


def author_view(rows: DataFrame) -> DataFrame:
    """Rows (author, key, title, year, main_author, ...) with their list, works or contributed, and their place in it.

    Newest first, unknown last, then title and key.
    """
    group = F.when(F.col("main_author"), "works").otherwise("contributed")
    order = Window.partitionBy("author", "list").orderBy(F.col("year").desc_nulls_last(), F.lower("title"), "key")
    return rows.withColumn("list", group).withColumn("place", F.row_number().over(order))


def unlinked_groups(records: DataFrame) -> DataFrame:
    """Records under a name that no listed work has, one row for each catalogued title.

    Rows (already without linked and joining ones): author, pos, id, title, core (its core
    title), year, credited (the head's display name, null for the person).
    """
    key = F.lower(F.trim(F.coalesce(F.nullif(F.col("core"), F.lit("")), "title")))
    names = F.transform(F.array_sort(F.collect_set(F.when(F.col("credited").isNotNull(), F.struct("first", "credited")))), lambda x: x["credited"])
    first = Window.partitionBy("author", "group", "credited")
    held = records.withColumn("group", key).withColumn("first", F.min("pos").over(first))
    return held.groupBy("author", "group").agg(
        F.min_by("title", "pos").alias("title"), F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.slice(names, 1, 3).alias("credited_to"),
    )


def leaves(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facets to use, nodes to split) of a capped source's answers: a facet of 50 may be cut and is asked again, narrower.

    Rows: author, node, depth, items (its facet's size), total.
    """
    cut = F.col("items") >= FACET_CAP
    return nodes.where(~cut), nodes.where(cut)


def uncovered(tops: DataFrame, read: DataFrame) -> DataFrame:
    """(author, total, covered, uncovered): records of a name in no answer that was given whole."""
    per = read.groupBy(F.col("author").alias("__author")).agg(F.sum("total").alias("covered"))
    out = tops.join(per, F.col("author").eqNullSafe(F.col("__author")), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select("author", "total", "covered", F.greatest(F.lit(0), F.col("total") - F.col("covered")).alias("uncovered"))

"""Editions: records that share an ISBN; their fields; hints of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.publishers import pages_disagree, publisher_agrees
from folioforge.operators.components import by_shared_key
from folioforge.operators.store import first_of, present, with_united


def fold(records: DataFrame, codes: str = "codes") -> DataFrame:
    """``records`` (source, id, codes array) with ``edition_id``: the least code of the component, else source:id."""
    own = F.concat_ws(":", "source", "id")
    keyed = records.select(F.struct("source", "id").alias("node"), F.explode(codes).alias("code"))
    labels = by_shared_key(keyed, "node", "code").select(F.col("node.source").alias("source"), F.col("node.id").alias("id"), "label")
    return records.join(labels, ["source", "id"], "left").withColumn("edition_id", F.coalesce("label", own)).drop("label")


def edition_fields(records: DataFrame, key: str = "edition_id", seq: str = "seq") -> DataFrame:
    """The aggregate row of each edition."""
    kinds = dict(records.dtypes)
    firsts = [c for c in ("publisher", "series", "medium", "physical", "url", "cover_url", "isbn") if c in kinds]
    unions = [c for c in ("authors", "translators", "evidence", "holdings") if kinds.get(c, "").startswith("array")]
    known = F.col("language") != "unknown"
    years = F.sort_array(F.collect_set(F.nullif(F.col("year").cast("string"), F.lit(""))))
    out = records.groupBy(key).agg(
        F.min(seq).alias(seq), F.count("*").alias("records"), F.sort_array(F.collect_set("source")).alias("sources"),
        F.coalesce(first_of("language", seq, known), F.lit("unknown")).alias("language"), years.alias("printings"),
        F.coalesce(first_of("title", seq, present(F.col("title"), "string")), F.lit("")).alias("title"),
        *[first_of(c, seq, present(F.col(c), kinds[c])).alias(c) for c in firsts],
        *([F.bool_and("refused").alias("refused")] if "refused" in kinds else []),
    )
    out = with_united(out, records, [key], unions, seq)
    return out.withColumns({"year": F.try_element_at("printings", F.lit(1)), "latest": F.try_element_at("printings", F.lit(-1))})


def collisions(editions: DataFrame) -> DataFrame:
    """(a, b): editions of one language and year that may be one.

    Rows: edition_id, pos, language, year, sources array, isbn, publisher_keys array of
    arrays, pages array.  Hints only.  One of the two has no ISBN, and publishers that agree
    share a word, so rows without one meet the others on language, year and word.
    """
    known = editions.where((F.col("language") != "unknown") & F.col("year").isNotNull())
    each = known.withColumn("word", F.explode(F.array_distinct(F.flatten("publisher_keys"))))
    a, b = each.where("isbn is null").alias("a"), each.alias("b")
    tests = (
        (F.col("a.pos") != F.col("b.pos")) & ~F.arrays_overlap("a.sources", "b.sources")
        & publisher_agrees(F.col("a.publisher_keys"), F.col("b.publisher_keys")) & ~pages_disagree(F.col("a.pages"), F.col("b.pages"))
    )
    on = (F.col("a.language") == F.col("b.language")) & (F.col("a.year") == F.col("b.year")) & (F.col("a.word") == F.col("b.word"))
    ahead = F.col("a.pos") < F.col("b.pos")
    first, second = (F.when(x, F.col("a.edition_id")).otherwise(F.col("b.edition_id")) for x in (ahead, ~ahead))
    return a.join(b, on & tests).select(first.alias("a"), second.alias("b"), F.col("a.language").alias("language"), F.col("a.year").alias("year")).distinct()


def newest_first(rows: DataFrame, group: str, year: str, arrival: str, name: str = "place") -> DataFrame:
    """Place of each row in its group: newest first, undated last, then arrival."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.col(year).desc_nulls_last(), arrival)))

"""A whole lookup: sightings of several routes to the derived view of one work.

Stages are driver-side functions of DataFrames; every frame stays lazy.  ``Question``
and the known work are single rows, so they are literals, not joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import dates, isbn, publishers, text
from folioforge.operators import editions, gates, simjoin, store, view
from folioforge.operators import rows as rows_


@dataclass(frozen=True)
class Work:
    """The identity a lookup resolved: known titles, the original's language and year."""

    titles: list[str]
    original_language: str | None = None
    original_year: int | None = None
    authors: list[str] = field(default_factory=list)


def refused_query(title: str | None, author: str | None) -> str | None:
    """Why a question must not be sent to a catalogue's free-text search; None if it may."""
    if not (title or "").strip():
        return "no title"
    if not (author or "").strip():
        return "no author"
    if "/" in title:
        return "slash in the title"
    sent = text.romanise_text(title) + text.romanise_text(author)
    return None if all(not c.isalpha() or ord(c) < 0x250 for c in sent) else "not in Latin script"


def judge(candidates: DataFrame, work: Work) -> DataFrame:
    """``score``, ``evidence`` and ``refused`` of candidate sightings against the work's titles.

    A work has a handful of titles, so their tokens are literals in the plan.
    """
    spark = candidates.sparkSession
    known = simjoin.with_tokens(spark.createDataFrame([(t,) for t in work.titles] or [("",)], "title string"), "title").collect()
    rows = simjoin.with_tokens(candidates, "title")
    score = F.lit(0.0)
    for k in known:
        for tokens, plain in (("full", "plain"), ("core", "core_plain")):
            mine = F.array(*[F.lit(t) for t in k[tokens] or []]).cast("array<string>")
            score = F.greatest(score, text.title_similarity(F.col(tokens), mine, F.col(plain), F.lit(k[plain])))
    linked = F.col("route") == "work listing"
    rows = rows.withColumn("score", F.coalesce(score, F.lit(0.0)))
    evidence = F.coalesce(gates.identifies(linked, F.col("route") == "isbn probe", F.col("score")), F.lit("refused"))
    return rows.withColumn("evidence", evidence).withColumn("refused", F.col("evidence") == "refused").drop("full", "core", "plain", "core_plain")


def held_records(sightings: DataFrame) -> DataFrame:
    """Sightings (source, id, seq, route, ...) to records, with codes and settled years."""
    scalars = [c for c in ("title", "publisher", "year", "isbn", "physical", "medium", "date", "language") if c in sightings.columns]
    lists = [c for c in ("isbns_raw", "authors", "translators") if c in sightings.columns]
    known = sightings.withColumn("language", F.nullif("language", F.lit("unknown")))
    out = store.upsert(known, ["source", "id"], scalars=scalars, lists=lists, provenance=["route", "evidence", "score"], refused="refused")
    return out.withColumn("language", F.coalesce("language", F.lit("unknown"))).withColumn("codes", isbn.isbn_keys(F.col("isbn"), F.col("isbns_raw")))


def snapshot(sightings: DataFrame, work: Work, this_year: int) -> dict[str, DataFrame]:
    """The view's parts: editions, spans, facets, earliest, coverage, band and hints."""
    records = held_records(judge(sightings, work))
    asked = records.withColumns({"date_indexed": F.lit(None).cast("array<string>"), "date_check_failed": F.lit(False)})
    settled = dates.settle_rows(asked, "year", "date", "date_indexed", "date_check_failed", this_year)
    records = settled.withColumns({"year": F.col("settled.year"), "year_note": F.col("settled.note"), "years_shown": F.col("settled.shown"), "lookup": F.lit(1), "url": F.lit(None).cast("string")}).drop("settled", "date_indexed", "date_check_failed")
    folded = editions.fold(records.where("not refused")).withColumn("isbn", F.try_element_at("codes", F.lit(1)))
    rows = editions.edition_fields(folded)
    notes = view.row_note(folded, "edition_id", "year_note", dates.SEVERITY)
    rows = rows.join(notes, "edition_id", "left")
    keys = rows.withColumns({"publisher_keys": F.array(publishers.publisher_key(F.col("publisher"))), "pages": F.array_compact(F.array(publishers.page_count(F.col("physical")))), "pos": F.col("seq")})
    facet = rows.where("publisher is not null").withColumn("publisher_id", F.array_join(publishers.publisher_key(F.col("publisher")), " "))
    dated = rows.withColumns({"all": F.lit("all"), "year": F.col("year").cast("int"), "original_year": F.lit(work.original_year).cast("int"), "original": F.lit(work.original_language).cast("string")})
    return {
        "editions": editions.newest_first(rows, "language", "latest", "seq"),
        "spans": view.spans(rows, work.original_language, work.original_year),
        "facets": view.facets(facet, "publisher_id", "publisher"),
        "earliest": view.earliest(dated, "all", "original_year", "original"),
        "coverage": store.coverage(sightings.withColumn("refused", F.lit(False)), records, {"source": "source", "route": "route", "evidence": "evidence"}, "refused"),
        "band": rows_.band_rows(records),
        "hints": editions.collisions(keys),
    }

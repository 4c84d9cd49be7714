"""A whole lookup, or millions of them, over recorded answers: from questions to the view's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import dates, isbn
from folioforge.functions.langs import UNKNOWN, display
from folioforge.operators import editions, identity, rows, store
from folioforge.operators.scratch import written
from folioforge.plans import stages

LISTED = "lookup long, pos long, id string, title string, language string, translators array<string>, translation_evidence array<string>, statement string, publisher string, year string, date string, isbn string, isbns_raw array<string>, authors array<string>, medium string, physical string, url string, publisher_names array<string>, places array<string>"
WITHOUT_LANGUAGE = LISTED.replace("language string, ", "")
#: The recorded answers a run reads: each a table of this schema; a missing one is empty.
FRAMES = {
    "questions": "lookup long, title string, author string",
    "items": "lookup long, pos long, qid string, written boolean, edition boolean, author_agrees boolean, score double, form string",
    "item_facts": "qid string, original_title string, original_language string, original_year int, original_date struct<year:int,precision:int>, titles map<string,string>, item_authors array<string>",
    "guards": "lookup long, pos long, work string, tier string, agrees boolean",
    "docs": "lookup long, pos long, key string, title string, score double, edition_count int, by string, year int",
    "people": "lookup long, form_pos long, form string, n_tokens int, id string, pos long, name_key string, equal boolean, contains boolean, truncated boolean",
    "listing": LISTED + ", work string, page long", "whole": WITHOUT_LANGUAGE, "editions": LISTED + ", key string", "probes": LISTED, "sweeps": LISTED, "by_isbn": LISTED,
    "full": LISTED.replace("pos long, ", "full_id string, "),
    "index": "lookup long, language string, value string, id string", "index_failed": "lookup long, language string", "calls": "lookup long, source string, seconds double, error string, waited double",
}


def recorded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The frames of a folder of Parquet tables, one for each name; absent ones are empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}") if fs.exists(path(f"{folder}/{name}")) else spark.createDataFrame([], schema)
    return {name: read(name, schema) for name, schema in FRAMES.items()}


def run_to_end(frames: dict[str, DataFrame], this_year: int) -> dict[str, DataFrame]:
    """All stages, then the view: works, records, rows, headers, spans, publishers, band, ledger, notes and hints."""
    f = frames
    questions = identity.prepare(f["questions"])
    works = written(stages.identify(questions, f["items"], f["guards"], f["docs"], f["people"], f["item_facts"]).drop("title", "author", "notes").withColumn("authors", F.col("item_authors")))
    listed, n2, _ = stages.list_editions(works, f["listing"], f["whole"], f["editions"])
    first = written(listed)
    found, n3, _ = stages.recover(works, first, f["probes"], f["sweeps"], f["by_isbn"])
    plain = f["full"].where("full_id = id").drop("full_id")
    alone, _ = stages.reverse(works, questions, f["probes"], f["sweeps"], plain)
    sighted = written(stages.union(first, found, alone))
    brief = stages.held(sighted)
    more, n4, enriched = stages.enrich(works, brief, f["full"])
    sightings = written(stages.union(sighted, more))
    records = stages.held(sightings).withColumn("date_indexed", F.lit(None).cast("array<string>"))
    answers, checked = stages.check_dates(records, f["index"], f["index_failed"], this_year)
    records = store.attach_dates(records, answers, ["lookup", "source", "id"])
    settled = dates.settle_rows(records, "year", "date", "date_indexed", "date_check_failed", this_year)
    settled = settled.withColumns({"year": F.col("settled.year"), "year_note": F.col("settled.note"), "years_shown": F.col("settled.shown")}).drop("settled")
    notes = stages.union(*[n.withColumn("stage", F.lit(s)) for s, n in (("listing", n2), ("recovery", n3), ("enrich", n4))]).withColumnRenamed("seq", "pos")
    return view(works, written(settled), sightings) | {
        "works": works, "disbelieved": rows.disbelieved(notes, ["listing", "recovery", "enrich"]), "enriched": enriched, "dates_checked": checked, "causes": stages.causes(f["calls"]),
    }


def fold_by_lookup(records: DataFrame) -> DataFrame:
    """``records`` with ``edition_id``: components over shared codes inside each lookup."""
    mark = F.concat(F.col("lookup").cast("string"), F.lit("|"))
    keyed = records.withColumns({"own": F.col("id"), "id": F.concat(mark, "id"), "codes": F.transform(isbn.isbn_keys(F.col("isbn"), F.col("isbns_raw")), lambda c: F.concat(mark, c))})
    folded = editions.fold(keyed).withColumns({"id": F.col("own"), "edition_id": F.regexp_replace("edition_id", r"^(SBN:|Open Library:)?\d+\|", "$1")}).drop("own")
    return folded.withColumn("code", F.regexp_replace(F.try_element_at("codes", F.lit(1)), r"^\d+\|", "")).drop("codes")


def view(works: DataFrame, records: DataFrame, sightings: DataFrame) -> dict[str, DataFrame]:
    """The view's parts, each with a ``lookup`` column."""
    folded = written(fold_by_lookup(records.where("not refused")).withColumn("key", F.concat_ws("|", F.col("lookup").cast("string"), "edition_id")))
    shown = folded.drop("evidence", "isbn").withColumn("isbn", F.col("code")).withColumn("evidence", F.col("translation_evidence"))
    fields = editions.edition_fields(shown, "key").join(folded.select("key", "lookup", F.col("edition_id").alias("eid")).distinct(), "key")
    fields = fields.withColumn("edition_id", F.col("key"))
    fields = fields.withColumns({c: F.lit(None).cast("string") for c in ("series", "url", "physical", "medium", "publisher", "isbn") if c not in fields.columns})
    of_key = folded.drop("edition_id").withColumnRenamed("key", "edition_id")
    steps = sightings.where("not refused").select("lookup", "source", "id", F.col("seq").alias("route_seq"), "route", "evidence", "score", "via")
    routes = rows.provenance(of_key.select("edition_id", "lookup", "source", "id", "seq").join(steps, ["lookup", "source", "id"]))
    named = rows.named_publishers(of_key)
    groups, multi = fields.select("edition_id", F.lit("").alias("work_group")), rows.also_in(of_key.select("edition_id", "language").limit(0), fields)
    listed = rows.edition_rows(fields, rows.year_notes(of_key), rows.publisher_ids(named), routes, groups, multi, F.array().cast("array<array<string>>"))
    place = F.row_number().over(Window.partitionBy("lookup", "language").orderBy(F.col("latest").desc_nulls_last(), "seq"))
    listed = written(listed.withColumn("place", place).withColumn("id", F.regexp_replace("id", r"^\d+\|", "")))
    own = listed.withColumnRenamed("id", "edition_id")
    spans = own.where("not added").groupBy("lookup", "language").agg(F.count("*").alias("editions"), F.min(F.array_min("years_num")).alias("first_year"), F.max(F.array_max("years_num")).alias("last_year"))
    spans = spans.join(works.select("lookup", "original_language", "original_year"), "lookup").withColumn(
        "is_original", rows.span_is_original(F.col("language"), F.col("original_language"), F.col("original_year"), F.col("first_year"), F.col("last_year")),
    )
    order = Window.partitionBy("lookup").orderBy(F.col("language") == UNKNOWN, F.col("first_year").isNull(), "first_year", F.desc("editions"), "language")
    spans = spans.withColumns({"place": F.row_number().over(order), "name": display(F.col("language"))}).drop("original_language", "original_year")
    hints = editions.collisions(folded.groupBy("lookup", "edition_id").agg(
        F.min("seq").alias("pos"), F.min_by("language", "seq").alias("language"), F.min("year").alias("year"), F.collect_set("source").alias("sources"), F.min("code").alias("isbn"),
        F.array(F.min_by("publisher", "seq")).alias("names"), F.array_compact(F.array(F.max("physical"))).alias("physical"),
    ).withColumns({"language": F.concat_ws("|", F.col("lookup").cast("string"), "language"), "publisher_keys": F.transform("names", lambda n: F.split(F.lower(F.coalesce(n, F.lit(""))), " ")), "pages": F.array().cast("array<int>")}))
    return {
        "records": records, "rows": listed, "headers": rows.headers(own, works), "spans": spans, "publishers": rows.publisher_list(named), "band": rows.band_rows(records),
        "ledger": rows.ledger(records), "hints": rows.hint_pairs(hints),
    }

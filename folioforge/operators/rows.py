"""The view's rows: editions as a page reads them, the header, the band and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import langs, publishers, text, wording
from folioforge.functions.dates import SEVERITY, stated_when, year_of
from folioforge.operators.evidence import credited_to_another, origin_phrase
from folioforge.operators.view import earliest, header_authors

# The ledger's lines, the band's groups, and the routes and evidence they go by.
LEDGER_LINES = {
    "uniform title": "linked to this work in SBN",
    "title match": "found by other routes — SBN holds them but has not linked them",
    "isbn": "found by other routes — SBN holds them but has not linked them",
    "work key": "in Open Library's record for this work",
    "duplicate work": "in Open Library's other records for the same work",
}
REST_LINE = "admitted on other evidence"
BAND_GROUPS = {
    "matched": "matched against this work's titles and refused",
    "swept": "filed under this author's name in SBN — no title of this work identifies them",
}
AUTHOR_SWEEP, DUPLICATE_WORK = "author sweep", "duplicate work"


def years_of(printings: Column) -> Column:
    """An edition's printing years as numbers, earliest first."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(printings, year_of))))


def places_in(records: DataFrame, lookup: str = "lookup") -> DataFrame:
    """(lookup, known_places): the distinct places of a lookup's records, case-folded."""
    p = records.select(lookup, F.explode("places").alias("p")).where(F.col("p").isNotNull())
    return p.groupBy(lookup).agg(F.collect_set(F.lower(F.trim("p"))).alias("known_places"))


def publisher_names_on(names: Column, publisher: Column) -> Column:
    own = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(F.nullif(publisher, F.lit("")))))


def named_publishers(records: DataFrame, lookup: str = "lookup") -> DataFrame:
    """(lookup, edition_id, spelling, publisher_id): each publisher that a record names, without its places."""
    held = records.join(places_in(records, lookup), lookup, "left").withColumn("known_places", F.coalesce("known_places", F.array().cast("array<string>")))
    each = held.select(lookup, "edition_id", "known_places", F.explode(publisher_names_on(F.col("publisher_names"), F.col("publisher"))).alias("name"))
    spelled = each.select(lookup, "edition_id", F.trim(publishers.strip_places(F.col("name"), F.col("known_places"))).alias("spelling"))
    return spelled.withColumn("publisher_id", F.array_join(publishers.publisher_key(F.col("spelling")), " ")).where("publisher_id <> ''")


def publisher_ids(named: DataFrame, lookup: str = "lookup") -> DataFrame:
    return named.groupBy(lookup, "edition_id").agg(F.array_sort(F.collect_set("publisher_id")).alias("publisher_ids"))


def publisher_list(named: DataFrame, lookup: str = "lookup") -> DataFrame:
    """(lookup, publisher_id, label, editions, place): editions of each publisher, most first; the label is its commonest spelling."""
    n = named.groupBy(lookup, "publisher_id", "spelling").agg(F.count("*").alias("n"))
    label = n.groupBy(lookup, "publisher_id").agg(F.min_by("spelling", F.struct(-F.col("n"), F.length("spelling"), "spelling")).alias("label"))
    editions = named.groupBy(lookup, "publisher_id").agg(F.count_distinct("edition_id").alias("editions"))
    place = F.row_number().over(Window.partitionBy(lookup).orderBy(F.desc("editions"), "label", "publisher_id"))
    return editions.join(label, [lookup, "publisher_id"]).withColumn("place", place)


def year_notes(records: DataFrame, key: str = "edition_id") -> DataFrame:
    """(key, year_note, shown_years, statements, indexed, asked): an edition's least certain note.

    Rows: seq, year (settled), year_note, years_shown, date, date_indexed.  'no date' counts
    only where no record has a year.
    """
    rank = F.nullif(F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("year_note")), F.lit(0))
    dated = F.max(F.col("year").isNotNull())
    noted = F.col("year_note").isNotNull()
    first = F.min(F.when(noted, F.struct(rank.alias("rank"), "year_note")))
    certain = F.min(F.when(noted & (F.col("year_note") != "no date"), F.struct(rank.alias("rank"), "year_note")))
    wrote = F.transform(F.array_sort(F.collect_set(F.when(noted & (F.coalesce("date", F.lit("")) != ""), F.struct("seq", "date")))), lambda x: x["date"])
    return records.groupBy(key).agg(
        F.when(dated, certain["year_note"]).otherwise(first["year_note"]).alias("year_note"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("years_shown")))).alias("shown_years"), F.array_distinct(wrote).alias("statements"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(noted, F.col("date_indexed")))))).alias("indexed"), F.max(F.col("date_indexed").isNotNull()).alias("asked"),
    )


def note_of(note: Column, year: Column, shown: Column, statements: Column, indexed: Column, asked: Column) -> Column:
    """struct(note, label, shown, detail) of a row whose year isn't simply the one written; null for the others."""
    printing = note == "printed"
    none = F.array().cast("array<string>")
    years = F.when(year.isNull() & ~printing & (F.size(shown) > 0), F.array_join(shown, " / "))
    label = wording.year_label(note, F.when(printing, shown).otherwise(none))
    return F.when(note.isNotNull(), F.struct(note.alias("note"), label.alias("label"), years.alias("shown"), wording.year_detail(note, statements, indexed, asked).alias("detail")))


def provenance(routes: DataFrame, key: str = "edition_id") -> DataFrame:
    """(key, provenance, added_from, added): every route that reached an edition, in order.

    Rows: seq (of the record), route_seq, source, route, evidence, score, id, via; ``via`` of
    a duplicate work names the record it was added from.
    """
    step = F.struct("source", "route", "evidence", "score", F.col("id").alias("record"), "via")
    added = F.col("evidence") == DUPLICATE_WORK
    return routes.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "route_seq", step.alias("step")))), lambda x: x["step"]).alias("provenance"),
        F.array_sort(F.collect_set(F.when(added, F.col("via")))).alias("added_from"), F.bool_and(added).alias("added"),
    )


def also_in(multi: DataFrame, editions: DataFrame, key: str = "edition_id") -> DataFrame:
    """(key, also_in): other languages that an edition's records were filed under; multi: key, language."""
    other = multi.join(editions.select(key, F.col("language").alias("own")), key).where(F.col("language") != F.col("own")).select(key, "language").distinct()
    named = F.struct(F.col("language").alias("code"), langs.display(F.col("language")).alias("name"))
    return other.groupBy(key).agg(F.array_sort(F.collect_list(named)).alias("also_in"))


def edition_rows(fields: DataFrame, notes: DataFrame, ids: DataFrame, routes: DataFrame, groups: DataFrame, multi: DataFrame, form_tokens: Column) -> DataFrame:
    """The rows of the edition list.

    fields: ``editions.edition_fields`` (with ``lookup``); notes: ``year_notes``; ids:
    ``publisher_ids``; routes: ``provenance``; groups: edition_id, work_group; multi:
    ``also_in``; form_tokens: token arrays of the author's known forms.
    """
    none = F.array().cast("array<string>")
    e = fields.join(notes, "edition_id", "left").join(ids.drop("lookup"), "edition_id", "left").join(routes, "edition_id", "left").join(groups, "edition_id", "left").join(multi, "edition_id", "left")
    e = e.withColumn("author_tokens", text.normalize(F.try_element_at("authors", F.lit(1))))
    return e.select(
        "lookup", F.col("edition_id").alias("id"), "isbn", "title", "publisher", "year", note_of(*[F.col(c) for c in ("year_note", "year", "shown_years", "statements", "indexed", "asked")]).alias("year_note"),
        year_of(F.col("year")).alias("year_num"), years_of(F.col("printings")).alias("years_num"), "latest", F.coalesce("publisher_ids", none).alias("publisher_ids"), "printings", "language",
        langs.display(F.col("language")).alias("language_name"), "sources", "series", "physical", "medium", credited_to_another(F.col("authors"), F.col("author_tokens"), form_tokens).alias("credited_to"),
        "also_in", "url", F.transform("authors", text.author_display).alias("authors"), F.transform("translators", text.author_display).alias("translators"), "evidence",
        F.coalesce("work_group", F.lit("")).alias("work_group"), "provenance", "added_from", F.coalesce("added", F.lit(False)).alias("added"), "seq",
    )


def author_forms(authors: Column, headings: Column) -> Column:
    """Every name a work's author is known by."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(authors, none), F.coalesce(headings, none))


def band_rows(records: DataFrame) -> DataFrame:
    """Refused records as the band draws them, in two groups, best score first, dated before undated, newest first, then id."""
    group = F.when(F.col("route") == AUTHOR_SWEEP, "swept").otherwise("matched")
    year = F.coalesce("year", F.nullif(F.array_join(F.coalesce("years_shown", F.array().cast("array<string>")), " / "), F.lit("")))
    rows = records.where("refused").select("lookup", "id", "source", F.coalesce("title", F.lit("")).alias("title"), year.alias("year"), "publisher", "url", "route", "score", group.alias("group"))
    order = Window.partitionBy("lookup", "group").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), year_of(F.col("year")).desc_nulls_last(), F.coalesce("id", F.lit("")))
    return rows.withColumn("place", F.row_number().over(order))


def display_titles(editions: DataFrame, works: DataFrame) -> DataFrame:
    """(lookup, title): the original's, the one in the original language, the earliest edition's core title, or the commonest.

    works: lookup, original_title, original_language, titles (map of language to title).
    """
    e = editions.withColumns({"y": year_of(F.col("year")), "core": text.core_title(F.col("title"))})
    first = e.where("y is not null").groupBy("lookup").agg(F.min_by("core", F.struct("y", "edition_id")).alias("earliest"))
    n = e.where("core <> ''").groupBy("lookup", "core").agg(F.count("*").alias("n"))
    mode = n.groupBy("lookup").agg(F.min_by("core", F.struct(-F.col("n"), "core")).alias("commonest"))
    full = lambda c: F.nullif(c, F.lit(""))
    own = full(F.try_element_at("titles", F.col("original_language")))
    out = works.join(first, "lookup", "left").join(mode, "lookup", "left")
    return out.select("lookup", F.coalesce(full(F.col("original_title")), own, "earliest", "commonest", F.lit("")).alias("title"))


def original_is_stated(stated_by: Column) -> Column:
    return F.coalesce(stated_by, F.lit("")) != ""


def span_is_original(language: Column, original_language: Column, original_year: Column, first_year: Column, last_year: Column) -> Column:
    """The original's language, and its year inside the span where both are known."""
    same = F.coalesce(language == original_language, F.lit(False))
    known = original_year.isNotNull() & first_year.isNotNull()
    return same & (~known | F.coalesce(original_year.between(first_year, last_year), F.lit(False)))


def headers(editions: DataFrame, works: DataFrame) -> DataFrame:
    """One row a lookup: the work's title, authors, stated original, earliest edition and number of editions.

    editions: lookup, edition_id, seq, title, authors, language, year, added (left out
    here).  works: lookup, original_title, original_language, original_year,
    original_date (struct(year, precision)), stated_by, basis, titles, authors.
    """
    own = editions.where("not added")
    dated = own.withColumn("year", year_of(F.col("year"))).join(works.select("lookup", "original_year", "original_language"), "lookup")
    seen = dated.groupBy("lookup").agg(F.count("*").alias("total_editions"), F.min("year").alias("first_year_seen"))
    early = earliest(dated, "lookup", "original_year", "original_language").withColumnsRenamed({"year": "earliest_year", "languages": "earliest_languages", "lead_seq": "earliest_seq"})
    names = header_authors(own, "lookup", "authors", "seq").withColumnRenamed("authors", "edition_authors")
    stated = original_is_stated(F.col("stated_by"))
    language = langs.display(F.col("original_language"))
    shown = F.slice(F.array_distinct(F.filter(F.transform(F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("edition_authors")), text.author_display), lambda a: a != "")), 1, 3)
    w = works.join(display_titles(own, works), "lookup", "left").join(seen, "lookup", "left").join(early, "lookup", "left").join(names, "lookup", "left")
    phrase = F.when(stated, origin_phrase(stated_when(F.col("original_date")["year"], F.col("original_date")["precision"]), F.when(F.col("original_language").isNotNull(), language), F.lit(None).cast("int"))).otherwise("")
    return w.select(
        "lookup", "title", shown.alias("authors"), "original_title", "original_language", F.when(F.col("original_language").isNotNull(), language).alias("original_language_name"), "original_year",
        stated.alias("original_stated"), F.coalesce("stated_by", F.lit("")).alias("original_stated_by"), "first_year_seen", "earliest_year", "earliest_languages", "earliest_seq", "older_dropped",
        F.coalesce("total_editions", F.lit(0)).alias("total_editions"), F.coalesce(phrase, F.lit("")).alias("origin"), (F.coalesce("total_editions", F.lit(0)) > 0).alias("found"),
    )


def ledger(records: DataFrame) -> DataFrame:
    """(lookup, line, n): admitted records by what admitted them; every record is on exactly one line."""
    line = F.lit(REST_LINE)
    for evidence, name in LEDGER_LINES.items():
        line = F.when(F.col("evidence") == evidence, name).otherwise(line)
    return records.where("not refused").groupBy("lookup", line.alias("line")).agg(F.count("*").alias("n"))


def disbelieved(notes: DataFrame, order: list[str]) -> DataFrame:
    """Languages that weren't believed, in the order of the stages; each (lookup, record) once, as first noted.

    Rows: lookup, stage, pos, record, language, why.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    first = F.row_number().over(Window.partitionBy("lookup", "record").orderBy(place, "pos"))
    return notes.withColumn("first", first).where("first = 1").drop("first")


def multi_language(pages: DataFrame) -> DataFrame:
    """(lookup, id, languages): records that came back on two language pages; rows: lookup, id, pos, language."""
    g = pages.groupBy("lookup", "id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "language"))), lambda x: x["language"]).alias("languages"))
    return g.where(F.size("languages") > 1)


def title_chooser(books: DataFrame, questions: DataFrame) -> DataFrame:
    """(lookup, title, heading, books) of bare titles that several books bear, most editions first."""
    row = F.struct((-F.col("editions")).alias("o"), F.array_join("authors", " ").alias("a"), F.struct("authors", "title", "first_year", "editions", "sources").alias("book"))
    g = books.groupBy("lookup").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["book"]).alias("books")).where("n > 1")
    return g.join(questions.select("lookup", "title"), "lookup").select("lookup", "title", wording.books_share_title(F.col("n"), F.col("title")).alias("heading"), "books")


def hint_pairs(hints: DataFrame) -> DataFrame:
    """Duplicate hints from each row's side."""
    return hints.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(hints.select(F.col("b").alias("id"), F.col("a").alias("other")))


def language_chips(spans: DataFrame) -> DataFrame:
    """Place of each language in a filter: unknown last, most editions first, then code."""
    order = Window.partitionBy("lookup").orderBy(F.col("language") == "unknown", F.desc(F.col("editions") + F.coalesce("added", F.lit(0))), "language")
    return spans.withColumn("chip", F.row_number().over(order))

"""Raw catalogue bodies to records, one function a source."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from folioforge.functions import imprint, langs, publishers, text

BRIEF = (
    "struct<codiceIdentificativo:string,titolo:string,pubblicazione:string,nomi:array<string>,numeri:array<string>,isbn:string,note:array<string>,"
    "linguaPubblicazione:string,classificazioneDewey:string,collezione:string,descrizioneFisica:string,tipo:string,copertina:string,"
    "localizzazioni:array<struct<isil:string,denominazione:string,shelfmarks:array<struct<shelfmark:string,invNum:string>>>>>"
)
EDITION = (
    "struct<key:string,title:string,publishers:array<string>,publish_date:string,publish_places:array<string>,languages:array<struct<key:string>>,"
    "isbn_10:array<string>,isbn_13:array<string>,series:array<string>,number_of_pages:int,translation_of:string,works:array<struct<key:string>>>"
)
BOOK = (
    "struct<key:string,title:string,subtitle:string,edition_name:string,by_statement:string,physical_format:string,number_of_pages:int,pagination:string,"
    "publish_places:array<string>,publish_date:string,publishers:array<string>,series:array<string>,contributions:array<string>,isbn_13:array<string>,"
    "isbn_10:array<string>,covers:array<long>,ocaid:string,description:string,notes:string,first_sentence:string,translation_of:string,"
    "translated_from:array<struct<key:string>>>"
)
DOC = (
    "struct<key:string,title:string,publisher:array<string>,first_publish_year:int,language:array<string>,isbn:array<string>,ddc:array<string>,"
    "author_name:array<string>,author_key:array<string>,edition_count:int>"
)
LISTING = (
    "struct<data:struct<total:int,results:array<struct<id:string,type:string,title:struct<info:string,text:string>,infos:array<string>>>,"
    "facets:array<struct<name:string,items:array<struct<label:string,results:int,value:string>>>>>>"
)
# Addresses, the form of an id, record types, host records, and words that tell of a translation.
PERMALINK, WORKS, BOOKS = "https://opac.sbn.it/bid/", "https://openlibrary.org/works/", "https://openlibrary.org/books/"
COVER, ARCHIVE = "https://covers.openlibrary.org/b/id/%s-M.jpg", "https://archive.org/details/%s"
ID = r"^(?:ITICCU)?([A-Z]{2,4}[0-9A-Z]{6,12})$"
RECORD_TYPE = r"^([^\[]+?)\s+-\s+([^\[]+?)\s*\[IT.ICCU"
PART_OF = r"(?i)^Fa parte di\s*:"
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
TRANSLATION = r"(?i)\btrad(?:\.|uzion\w*|ott\w*|\. it\w*)|\bversione (?:italiana|di)\b"
RESPONSIBILITY = r"(?i)\b(translated (?:from|by)|tradotto dal|tradotta dal|traduit (?:du|par)|traducido del|ubersetzt|übersetzt)\b"
PAGE_ROWS, MOST_PAGES = 20, 12


def none() -> Column:
    return F.array().cast("array<string>")


def full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def valid_id(raw: Column) -> Column:
    return full(F.regexp_extract(F.trim(raw), ID, 1))


def _labelled(items: Column, opens: str) -> Column:
    """Values under labels that open with a word."""
    return F.transform(F.filter(imprint.labelled(F.coalesce(items, none())), lambda x: F.lower(x["label"]).startswith(opens)), lambda x: x["value"])


def tells_translation(statement: Column) -> Column:
    return F.coalesce(statement.rlike(RESPONSIBILITY) | statement.rlike(TRANSLATION), F.lit(False))


def holdings(localizations: Column) -> Column:
    """(library, city, isil) of each shelf mark; the source has the library's name in ``shelfmark`` and the city in ``invNum``."""
    clean = lambda c: F.coalesce(text.clean_text(c), F.lit(""))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("shelfmark"), F.lit(None).cast("string").alias("invNum")))
    marks = lambda x: F.when(F.size(x["shelfmarks"]) > 0, x["shelfmarks"]).otherwise(empty)
    one = lambda x: F.transform(marks(x), lambda m: F.struct(
        clean(F.coalesce(full(m["shelfmark"]), x["denominazione"])).alias("library"), clean(m["invNum"]).alias("city"), clean(x["isil"]).alias("isil"),
    ))
    return F.flatten(F.transform(F.coalesce(localizations, F.from_json(F.lit("[]"), "array<struct<isil:string,denominazione:string,shelfmarks:array<struct<shelfmark:string,invNum:string>>>>")), one))


def publication() -> list[Column]:
    """The columns that an imprint, parsed as ``p``, gives a record."""
    stated = F.concat_ws(", ", "p.publisher", "p.place")
    return [
        full(stated).alias("publisher"), F.col("p.year").alias("year"), F.col("p.statement").alias("date"),
        F.coalesce(publishers.publisher_names(F.col("p.publisher")), none()).alias("publisher_names"), F.array_compact(F.array("p.place")).alias("places"),
    ]


def brief_records(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Records of the national catalogue's full or brief bodies; a brief one has no language."""
    r = bodies.select("*", F.from_json(body, BRIEF).alias("r"))
    p = r.withColumns({"p": imprint.parse_publication(text.clean_text(F.col("r.pubblicazione"))), "raw": F.coalesce(text.clean_text(F.col("r.titolo")), F.lit(""))})
    p = p.withColumns({"translators": _labelled(F.col("r.nomi"), "tradutt"), "said": text.statement_of(F.col("raw")), "codes": F.concat(_labelled(F.col("r.numeri"), "isbn"), F.array_compact(F.array(full(F.col("r.isbn")))))})
    notes = F.filter(F.transform(F.coalesce("r.note", none()), text.clean_text), lambda n: F.coalesce(n.rlike(TRANSLATION), F.lit(False)))
    evidence = F.concat(notes, F.when(tells_translation(F.col("said")), F.array("said")).otherwise(none()), F.transform("translators", lambda t: F.concat(F.lit("Traduttore: "), t)))
    dewey = imprint.dewey_all(F.col("r.classificazioneDewey"))
    return p.select(
        *[c for c in bodies.columns if c != body], F.lit("SBN").alias("source"), imprint.short_id(F.col("r.codiceIdentificativo")).alias("id"), text.title_of(F.col("raw")).alias("title"), *publication(),
        langs.from_label(F.col("r.linguaPubblicazione")).alias("language"), F.try_element_at("codes", F.lit(1)).alias("isbn"), F.col("codes").alias("isbns_raw"),
        F.concat(F.lit(PERMALINK), imprint.short_id(F.col("r.codiceIdentificativo"))).alias("url"), text.clean_text(F.col("r.collezione")).alias("series"), text.clean_text(F.col("r.descrizioneFisica")).alias("physical"),
        F.try_element_at(dewey, F.lit(1)).alias("dewey"), dewey.alias("dewey_all"), text.clean_text(F.col("r.tipo")).alias("medium"), full(F.col("r.copertina")).alias("cover_url"),
        _labelled(F.col("r.nomi"), "autore").alias("authors"), "translators", F.col("said").alias("statement"), evidence.alias("translation_evidence"), holdings(F.col("r.localizzazioni")).alias("holdings"),
    )


def edition_records(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Records of open-catalogue edition bodies: first known language, 13-digit codes before 10-digit ones."""
    r = bodies.select("*", F.from_json(body, EDITION).alias("r"))
    codes = F.concat(F.coalesce("r.isbn_13", none()), F.coalesce("r.isbn_10", none()))
    known = F.filter(F.transform("r.languages", lambda x: langs.from_key(x["key"])), lambda c: c != langs.UNKNOWN)
    return r.select(
        *[c for c in bodies.columns if c != body], F.lit("Open Library").alias("source"), full(F.element_at(F.split("r.key", "/"), -1)).alias("id"), F.coalesce("r.title", F.lit("")).alias("title"),
        full(F.array_join("r.publishers", ", ")).alias("publisher"), full(F.regexp_extract("r.publish_date", YEAR, 1)).alias("year"), full(F.trim("r.publish_date")).alias("date"),
        F.coalesce(publishers.listed_publishers(F.col("r.publishers")), none()).alias("publisher_names"), F.coalesce("r.publish_places", none()).alias("places"),
        F.coalesce(F.try_element_at(known, F.lit(1)), F.lit(langs.UNKNOWN)).alias("language"), F.try_element_at(codes, F.lit(1)).alias("isbn"), codes.alias("isbns_raw"),
        F.concat(F.lit(BOOKS[:-7]), "r.key").alias("url"), F.try_element_at("r.series", F.lit(1)).alias("series"), F.concat(F.col("r.number_of_pages").cast("string"), F.lit(" p.")).alias("physical"),
        F.col("r.translation_of").alias("translation_of"), F.array_compact(F.transform(F.coalesce("r.works", F.from_json(F.lit("[]"), "array<struct<key:string>>")), lambda w: w["key"])).alias("works"),
    )


@pandas_udf(T.StringType())
def plain_value(value: pd.Series) -> pd.Series:
    """Free text that is given bare or as an object with a ``value``."""

    def one(x: str | None) -> str:
        try:
            data = json.loads(x or "null")
        except ValueError:
            data = x
        found = data.get("value") if isinstance(data, dict) else x
        return str(found or "").strip()

    return value.map(one)


def book_details(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The fields an edition shows when it is opened; only positive cover numbers are covers."""
    r = bodies.select("*", F.from_json(body, BOOK).alias("r"))
    shown = lambda c: F.filter(F.coalesce(F.col(f"r.{c}"), none()), lambda x: F.coalesce(x, F.lit("")) != "")
    words = lambda c: F.coalesce(f"r.{c}", F.lit("")).alias(c)
    cover = F.try_element_at(F.filter("r.covers", lambda c: c > 0), F.lit(1))
    return r.select(
        *[c for c in bodies.columns if c != body], *[words(c) for c in ("title", "subtitle", "edition_name", "by_statement", "physical_format", "pagination", "publish_date", "translation_of")],
        F.col("r.number_of_pages").alias("pages"), shown("publish_places").alias("places"), *[shown(c).alias(c) for c in ("publishers", "series", "contributions")],
        F.concat(F.coalesce("r.isbn_13", none()), F.coalesce("r.isbn_10", none())).alias("isbns"), F.when(cover.isNotNull(), F.format_string(COVER, cover.cast("string"))).alias("cover_url"),
        F.when(F.trim("r.ocaid") != "", F.format_string(ARCHIVE, F.trim("r.ocaid"))).alias("archive_url"), *[plain_value(F.col(f"r.{c}")).alias(c) for c in ("description", "notes", "first_sentence")],
        F.transform(F.coalesce("r.translated_from", F.from_json(F.lit("[]"), "array<struct<key:string>>")), lambda x: langs.from_key(x["key"])).alias("translated_from"),
        F.concat(F.lit(BOOKS), F.regexp_replace("r.key", "^/books/|/+$", "")).alias("url"),
    )


def work_docs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Search documents, one row for a work."""
    r = bodies.select("*", F.from_json(body, DOC).alias("r"))
    known = F.filter(F.transform("r.language", langs.from_key), lambda c: c != langs.UNKNOWN)
    key = full(F.regexp_replace("r.key", "/works/|^/+|/+$", ""))
    first = lambda c: F.try_element_at(c, F.lit(1))
    return r.select(
        *[c for c in bodies.columns if c != body], F.lit("Open Library").alias("source"), key.alias("id"), F.coalesce("r.title", F.lit("")).alias("title"), first(F.col("r.publisher")).alias("publisher"),
        F.col("r.first_publish_year").cast("string").alias("year"), F.coalesce(first(known), F.lit(langs.UNKNOWN)).alias("language"), F.coalesce(F.array_sort(F.array_distinct(known)), none()).alias("languages"),
        first(F.col("r.isbn")).alias("isbn"), F.coalesce("r.isbn", none()).alias("isbns_raw"), F.concat(F.lit(WORKS), key).alias("url"), first(F.col("r.ddc")).alias("dewey"), F.coalesce("r.author_name", none()).alias("authors"),
        F.coalesce(publishers.listed_publishers(F.col("r.publisher")), none()).alias("publisher_names"), "r.edition_count",
        F.transform(F.coalesce("r.author_key", none()), lambda k: F.when(k.startswith("/"), k).otherwise(F.concat(F.lit("/authors/"), k))).alias("author_keys"),
    )


def imprint_of(infos: Column) -> Column:
    """The first info that looks like an imprint: with a colon or a year, and neither a record type, a host record nor an extent."""
    fits = lambda x: (x.contains(":") | x.rlike(YEAR)) & ~x.rlike(RECORD_TYPE) & ~x.rlike(PART_OF) & ~x.rlike(r"(?i)^\W*(?:\d{1,3}|[ivxlc]+)\W*(?:,\W*(?:\d{1,3}|[ivxlc]+)\W*)*\s*(?:p|c|v|vol|voll|volumi|cd|dvd)\b")
    return F.try_element_at(F.filter(F.transform(F.coalesce(infos, none()), text.clean_text), lambda x: F.coalesce(fits(x), F.lit(False))), F.lit(1))


def record_type_of(infos: Column) -> Column:
    """struct(medium, level) of the info that says what kind of record it is."""
    found = F.try_element_at(F.filter(F.transform(F.coalesce(infos, none()), text.clean_text), lambda x: F.coalesce(x.rlike(RECORD_TYPE), F.lit(False))), F.lit(1))
    return F.struct(F.trim(F.regexp_extract(found, RECORD_TYPE, 1)).alias("medium"), F.trim(F.regexp_extract(found, RECORD_TYPE, 2)).alias("level"))


def listing_records(bodies: DataFrame, language: str | Column | None = None, body: str = "body") -> DataFrame:
    """Rows of a search body, in order; rows with a malformed id are dropped.

    A row's ``title.info`` is the title with its statement of responsibility, and
    ``title.text`` the main author's heading.
    """
    rest = [c for c in bodies.columns if c != body]
    r = bodies.select(*rest, F.posexplode(F.from_json(body, LISTING)["data"]["results"]).alias("pos", "row")).select(*rest, "pos", "row.*")
    r = r.withColumn("id", valid_id(F.col("id"))).where("id is not null")
    p = r.withColumns({"p": imprint.parse_publication(imprint_of(F.col("infos"))), "raw": text.volume_title(F.coalesce(text.clean_text(F.col("title.info")), F.lit(""))), "kind": record_type_of(F.col("infos"))})
    p = p.withColumn("statement", text.statement_of(F.col("raw")))
    code = language if isinstance(language, Column) else F.lit(language)
    author = text.clean_text(F.col("title.text"))
    return p.select(
        *rest, "pos", F.lit("SBN").alias("source"), "id", text.title_of(F.col("raw")).alias("title"), "statement", *publication(), langs.from_code(F.coalesce(code, F.lit(""))).alias("language"),
        F.concat(F.lit(PERMALINK), "id").alias("url"), full(F.lower("kind.medium")).alias("medium"), F.col("kind.level").alias("level"), F.array_compact(F.array(author)).alias("authors"),
        F.when(tells_translation(F.col("statement")), F.array("statement")).otherwise(none()).alias("translation_evidence"),
    )


def authority_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(pos, id, heading, kind) of a name authority's answers."""
    rest = [c for c in bodies.columns if c != body]
    r = bodies.select(*rest, F.posexplode(F.from_json(body, LISTING)["data"]["results"]).alias("pos", "row"))
    raw = F.trim("row.id")
    return r.select(*rest, "pos", F.coalesce(valid_id(raw), raw).alias("id"), F.trim(F.coalesce("row.title.text", F.lit(""))).alias("heading"), F.try_element_at("row.infos", F.lit(1)).alias("kind"))


def totals(bodies: DataFrame, cap: int = MOST_PAGES, body: str = "body") -> DataFrame:
    """(total, pages, truncated): how many rows a query has, and the pages that are read of it."""
    n = F.coalesce(F.from_json(body, LISTING)["data"]["total"], F.lit(0))
    pages = F.ceil(n / F.lit(PAGE_ROWS)).cast("int")
    return bodies.select(*[c for c in bodies.columns if c != body], n.alias("total"), F.least(pages, F.lit(cap)).alias("pages"), (pages > cap).alias("truncated"))


def _title_rows(body: str | None) -> list[tuple[str, object]]:
    """(title, cell) of the rows of a detail body's tables."""
    data = (json.loads(body or "null") or {}).get("data") or {}
    rows = [row for r in data.get("results") or [] for block in r.get("contents") or [] for row in block.get("body") or []]
    return [(row[0].get("value"), row[1]) for row in rows if len(row) > 1 and isinstance(row[0], dict) and row[0].get("type") == "table-title"]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("cell", T.StringType())])))
def table_rows(body: pd.Series) -> pd.Series:
    """The titled rows of a detail body, cells as JSON."""
    return body.map(lambda b: [{"title": t, "cell": json.dumps(c, ensure_ascii=False)} for t, c in _title_rows(b)])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())])))
def work_links(body: pd.Series) -> pd.Series:
    """The works that a record's body links to; links stand at any depth of its cell."""
    mark = "Titolo_uniforme:@frase@="

    def under(node) -> list[dict]:
        if isinstance(node, list):
            return [x for n in reversed(node) for x in under(n)]
        if not isinstance(node, dict):
            return []
        own = [{"id": v["href"].rsplit(mark, 1)[1], "label": v.get("value") or ""} for v in node.get("values") or [] if mark in (v.get("href") or "") and v["href"].rsplit(mark, 1)[1].isalnum()]
        return own + under(node.get("contents") or [])

    return body.map(lambda b: [x for t, c in _title_rows(b) if t == "Titolo di opera" for x in under(c)])


def work_authorities(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(language, variants) of a work's authority record: of rows with one title the last counts."""
    values = "struct<value:string,contents:array<struct<value:string>>>"
    r = bodies.withColumn("rows", table_rows(body))
    cell = lambda name: F.from_json(F.try_element_at(F.filter("rows", lambda x: x["title"] == name), F.lit(-1))["cell"], values)
    own = cell("Lingua")
    names = F.transform(cell("Forme varianti")["contents"], lambda c: c["value"])
    return r.select(
        *[c for c in bodies.columns if c != body], full(F.trim(own["value"])).alias("language"),
        F.filter(F.coalesce(names, none()), lambda v: F.coalesce(v, F.lit("")) != "").alias("variants"),
    )


def facet(bodies: DataFrame, name: str, body: str = "body") -> DataFrame:
    """(label, results, value) of one named facet."""
    facets = F.from_json(body, LISTING)["data"]["facets"]
    return bodies.select(F.inline(F.flatten(F.transform(F.filter(facets, lambda f: f["name"] == name), lambda f: f["items"]))))


ENTITY_TEXT = "struct<text:string,language:string>"
NAMESPACED = r"^[^\s:]+:\S"
# Sites that end in 'wiki' and aren't a Wikipedia.
NOT_WIKIPEDIA = [
    "abstractwiki", "commonswiki", "foundationwiki", "incubatorwiki", "mediawikiwiki", "metawiki", "outreachwiki", "sourceswiki", "specieswiki", "wikidatawiki",
    "wikifunctionswiki", "wikimaniawiki",
]


def claim_ids(v: Column, prop: str) -> Column:
    """The items that a property names."""
    claims = F.try_variant_get(v, f"$.claims.{prop}", "array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>")
    return F.coalesce(F.array_compact(F.transform(claims, lambda c: c["mainsnak"]["datavalue"]["value"]["id"])), none())


def item_forms(labels: Column, sitelinks: Column, original: Column, names_only: bool = False) -> Column:
    """Every name of an item: labels by language, sites' titles without a disambiguator, its original title; each once.

    ``names_only`` leaves out other projects' pages in a namespace.
    """
    own = F.transform(F.array_sort(F.map_entries(labels)), lambda e: e["value"]["value"])
    entries = F.array_sort(F.map_entries(sitelinks))
    if names_only:
        other = lambda e: ~e["key"].endswith("wiki") | e["key"].isin(NOT_WIKIPEDIA)
        entries = F.filter(entries, lambda e: ~(e["value"]["title"].rlike(NAMESPACED) & other(e)))
    pages = F.transform(entries, lambda e: F.trim(text.strip_disambiguator(e["value"]["title"])))
    all_ = F.concat(F.coalesce(own, none()), F.coalesce(pages, none()), F.array(original))
    return F.array_distinct(F.filter(all_, lambda x: F.coalesce(x, F.lit("")) != ""))


def entities(bodies: DataFrame, wikis: tuple[str, ...] = ("it", "en", "fr", "es", "de"), body: str = "body", names_only: bool = False) -> DataFrame:
    """Items, read as VARIANT: names, classes, authors, translators, the original's title, language and date, titles by language."""
    v = bodies.select("qid", F.parse_json(body).alias("v"))
    labels = F.try_variant_get("v", "$.labels", "map<string,struct<value:string>>")
    links = F.try_variant_get("v", "$.sitelinks", "map<string,struct<title:string>>")
    found = F.try_variant_get("v", "$.claims.P577", "array<struct<rank:string,mainsnak:struct<datavalue:struct<value:struct<time:string,precision:int>>>>>")
    original = F.try_variant_get("v", "$.claims.P1476[0].mainsnak.datavalue.value", ENTITY_TEXT)
    value = lambda c: c["mainsnak"]["datavalue"]["value"]
    year = lambda c: F.regexp_extract(value(c)["time"], r"^([+-]\d+)-", 1).try_cast("int")
    good = F.filter(found, lambda c: F.coalesce(c["rank"] != "deprecated", F.lit(True)) & F.coalesce(year(c) != 0, F.lit(False)))
    when = F.array_min(F.transform(good, lambda c: F.struct(year(c).alias("year"), (-F.coalesce(F.nullif(value(c)["precision"], F.lit(0)), F.lit(9))).alias("p"))))
    stated = langs.from_item(F.try_element_at(claim_ids(F.col("v"), "P407"), F.lit(1)))
    language = F.when(stated != langs.UNKNOWN, stated).when(original["language"].isNotNull(), langs.from_two_letter(original["language"])).otherwise(langs.UNKNOWN)
    title_of = lambda two: F.coalesce(F.try_element_at(labels, F.lit(two))["value"], F.trim(text.strip_disambiguator(F.try_element_at(links, F.lit(f"{two}wiki"))["title"])))
    by_language = F.map_from_entries(F.filter(F.array(*[F.struct(langs.from_two_letter(F.lit(w)).alias("key"), title_of(w).alias("value")) for w in wikis]), lambda e: e["value"].isNotNull()))
    out = v.select(
        "qid", F.map_from_entries(F.filter(F.map_entries(F.transform_values(labels, lambda k, x: x["value"])), lambda e: e["key"].isin(*wikis))).alias("labels"), item_forms(labels, links, original["text"], names_only).alias("names"),
        claim_ids(F.col("v"), "P31").alias("kinds"), claim_ids(F.col("v"), "P50").alias("authors"), claim_ids(F.col("v"), "P655").alias("translators"), F.concat(claim_ids(F.col("v"), "P179"), claim_ids(F.col("v"), "P361")).alias("part_of"),
        original["text"].alias("original_title"), language.alias("original_language"), by_language.alias("titles"), when["year"].alias("date_year"), (-when["p"]).alias("precision"),
    )
    return out.withColumn("original_year", F.when((F.col("precision") >= 9) & (F.col("date_year") > 0), F.col("date_year")))


def label_of(labels: Column, order: tuple[str, ...] = ("en", "it", "fr", "es", "de")) -> Column:
    """One label, by preference of languages."""
    return F.coalesce(*[F.try_element_at(labels, F.lit(x)) for x in order])


def language_codes(rows: DataFrame, language: str = "language") -> DataFrame:
    """The known languages of rows."""
    return rows.select(language).where(F.col(language).isNotNull() & ~F.col(language).isin([langs.UNKNOWN, *langs.NO_LANGUAGE])).distinct()

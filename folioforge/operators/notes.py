"""Lines on what a lookup read only in part, refused to ask, or asked under other spellings.

Evidence is one row a lookup with nested columns (EVIDENCE); each function gives an
array of lines in the order the stages ran, so lookups by the million are one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.wording import number, quoted, read_of

EVIDENCE = (
    "identity struct<facet_truncated:boolean,title_item:boolean,spellings:array<string>,offered:int,filed_under:array<string>,"
    "author_forms:int,author_why_not:string,author_ids:array<string>,authority:string,title_asked:boolean,author_asked:boolean>, "
    "listing struct<rows:long,total:long,truncated:boolean,facet_truncated:boolean,why_not:array<string>>, "
    "recovery struct<why_not:string,sweep:struct<rows:long,total:long,truncated:boolean,why_not:string>,"
    "others:array<struct<authority:string,rows:long,total:long,truncated:boolean>>,"
    "probes:array<struct<title:string,rows:long,total:long,truncated:boolean,why_not:string>>>, "
    "enrich struct<asked:long,rows:long,truncated:boolean>, "
    "dates struct<checked:long,rows:long,truncated:boolean,asked_years:long,wanted_years:long,years_truncated:boolean>, "
    "duplicates struct<why_not:string,queries:array<struct<title:string,docs:long,total:long>>>"
)
AUTHOR_EVIDENCE = (
    "names array<struct<name:string,languages_capped:boolean,split:boolean,total:long,covered:long,capped_leaves:array<string>>>, "
    "wikidata struct<read:long,total:long>, open_library struct<read:long,total:long>, unlinked array<struct<read:long,total:long,truncated:boolean>>, "
    "dates struct<checked:long,rows:long,truncated:boolean>, years_capped int"
)

# The formats of the lines.
FIRST_TITLES = "SBN offered 50 uniform titles for this question and stops there, so the work was chosen from the first 50"
FIRST_LANGUAGES = "SBN lists at most 50 languages for a work, so a language beyond the 50th was reached only by the unfiltered pass"
NO_ITEM = "other spellings of the title: none asked — Wikidata has no item for this work to give them"
NO_SPELLING = "other spellings of the title: Wikidata gives none SBN can be asked"


def some(*lines: Column) -> Column:
    """The lines that aren't null."""
    return F.array_compact(F.array(*[x.cast("string") for x in lines]))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def each(rows: Column, line) -> Column:
    """The lines of an array's items, without nulls; empty for a null array."""
    return F.coalesce(F.array_compact(F.transform(rows, line)), F.array().cast("array<string>"))


def truncations() -> Column:
    """One line for each cap that a lookup hit."""
    i, li, r, e, d = (F.col(c) for c in ("identity", "listing", "recovery", "enrich", "dates"))
    asked = F.coalesce(F.size(i["spellings"]), F.lit(0))
    spellings = text("of the ", i["offered"].cast("string"), " other spellings of the title Wikidata gives, the first ", asked.cast("string"), " were asked of SBN")
    cut = true(li["truncated"]) | true((li["total"] > 0) & (F.coalesce(li["rows"], F.lit(0)) < li["total"]))
    sweep = text("the author sweep ", read_of(r["sweep"]["rows"], r["sweep"]["total"], "records filed under this name"))
    enriched = text(
        "full records were read for ", number(e["asked"]), " of ", number(e["rows"]),
        " SBN rows; the rest are listed as the listing has them, so their printings are not grouped",
    )
    years = text(
        "SBN's index was asked about ", number(d["asked_years"]), " of ", number(d["wanted_years"]),
        " years whose counts disagree with the listing; rows under the rest keep the year they state",
    )
    other = lambda x: F.when(true(x["truncated"]), text("the sweep of SBN's name record ", x["authority"], " ", read_of(x["rows"], x["total"], "records filed under that spelling")))
    probe = lambda x: F.when(true(x["truncated"]), text("the title probe for ", quoted(x["title"]), " ", read_of(x["rows"], x["total"], "records")))
    return F.concat(
        some(F.when(true(i["facet_truncated"]), FIRST_TITLES), F.when((asked > 0) & true(i["offered"] > asked), spellings)),
        some(F.when(cut, text("the SBN listing ", read_of(li["rows"], li["total"], "records filed under this work"))), F.when(true(li["facet_truncated"]), FIRST_LANGUAGES)),
        some(F.when(true(r["sweep"]["truncated"]), sweep)), each(r["others"], other), each(r["probes"], probe),
        some(F.when(true(e["truncated"]), enriched), date_line(d, "rows"), F.when(true(d["years_truncated"]), years), duplicate_line()),
    )


def date_line(d: Column, what: str) -> Column:
    return F.when(true(d["truncated"]), text(
        "dates were checked with SBN for ", number(d["checked"]), " of ", number(d["rows"]), f" {what} whose year is not plain; the rest are labelled year unsure",
    ))


def duplicate_line() -> Column:
    """One line for all searches of which only the first page was read."""
    over = F.filter(F.col("duplicates")["queries"], lambda q: true((q["total"] > 0) & (F.coalesce(q["docs"], F.lit(0)) < q["total"])))
    read, most = F.array_max(F.transform(over, lambda q: F.coalesce(q["docs"], F.lit(0)))), F.array_max(F.transform(over, lambda q: q["total"]))
    one = text("the search for Open Library's other records under ", quoted(F.try_element_at(over, F.lit(1))["title"]), " ", read_of(read, most, "results"))
    many = text("the ", F.size(over).cast("string"), " searches for Open Library's other records read the first ", number(read), " results each, and each found more (up to ", number(most), ")")
    return F.when(F.size(over) == 1, one).when(F.size(over) > 1, many)


def not_asked() -> Column:
    """Why queries weren't sent, in stage order."""
    r = F.col("recovery")
    probe = lambda x: F.when(x["why_not"].isNotNull(), text(quoted(x["title"]), ": ", x["why_not"]))
    return F.concat(
        each(F.col("listing")["why_not"], lambda x: x), some(r["why_not"]), each(r["probes"], probe), some(r["sweep"]["why_not"]), some(F.col("duplicates")["why_not"]),
    )


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def spellings() -> Column:
    """What each spelling switch asked and found."""
    i, sweeps = F.col("identity"), F.col("recovery")["others"]
    asked, works = i["spellings"], F.array_sort(F.array_distinct(F.coalesce(i["filed_under"], F.array().cast("array<string>"))))
    names = lambda xs: F.array_join(F.transform(xs, quoted), ", ")
    found = F.when(F.size(works) > 0, text("; SBN files them under ", names(works))).otherwise("; SBN files none of them under a work")
    title = F.when(~true(i["title_item"]), NO_ITEM).when(F.coalesce(F.size(asked), F.lit(0)) == 0, NO_SPELLING).otherwise(text("other spellings of the title asked of SBN: ", names(asked), found))
    head = "other spellings of the author: "
    others = F.filter(i["author_ids"], lambda x: ~x.eqNullSafe(i["authority"]))
    n, swept, forms = F.coalesce(F.size(others), F.lit(0)), F.coalesce(F.size(sweeps), F.lit(0)), i["author_forms"].cast("string")
    read = F.array_join(F.transform(sweeps, lambda s: text(s["authority"], " (", number(s["rows"]), " record", plural(F.coalesce(s["rows"], F.lit(0))), ")")), ", ")
    unswept = text(
        head, "SBN files the same person under ", n.cast("string"), " more name record", plural(n), " (", F.array_join(others, ", "),
        "), not swept: this lookup found no work to check their records against",
    )
    author = (
        F.when(F.coalesce(i["author_forms"], F.lit(0)) == 0, text(head, "none asked — ", F.coalesce(i["author_why_not"], F.lit("Wikidata did not answer"))))
        .when((n > 0) & (swept == 0), unswept)
        .when(swept > 0, text(head, forms, " asked of SBN, which files the same person under ", swept.cast("string"), " more name record", plural(swept), ", swept: ", read))
        .otherwise(text(head, forms, " asked of SBN, which files the person under no other name record"))
    )
    return some(F.when(true(i["title_asked"]), title), F.when(true(i["author_asked"]), author))


def author_truncations() -> Column:
    """Every place where an author's list of works was cut (columns: AUTHOR_EVIDENCE)."""
    name = lambda x: F.coalesce(x["name"], F.lit("this name"))
    uncovered = lambda x: F.coalesce(x["total"], F.lit(0)) - F.coalesce(x["covered"], F.lit(0))

    def of_name(x: Column) -> Column:
        leaves = F.coalesce(F.size(x["capped_leaves"]), F.lit(0))
        return some(
            F.when(true(x["languages_capped"]), text("SBN names at most 50 languages for ", name(x), ", so a language past the 50th was not asked on its own")),
            F.when(true(x["split"]) & (uncovered(x) > 0), text(
                "SBN lists at most 50 works per question, so ", name(x), "'s were asked again by language and by year; at least ", number(uncovered(x)), " of ",
                number(x["total"]), " records fell in no answer SBN gave in full, and a work held only by them is not listed",
            )),
            F.when(leaves > 0, text(leaves.cast("string"), " of those questions still stopped at 50 works (", F.array_join(F.slice(x["capped_leaves"], 1, 5), ", "), ")")),
        )

    part = lambda c, what: F.when(true((F.col(c)["total"] > 0) & (F.coalesce(F.col(c)["read"], F.lit(0)) < F.col(c)["total"])), read_of(F.col(c)["read"], F.col(c)["total"], what))
    unread = lambda x: F.when(true(x["truncated"]), text(read_of(x["read"], x["total"], "records under this name"), ", so a book held only by the rest is not among those filed under no work"))
    years = F.coalesce("years_capped", F.lit(0))
    late = text(
        years.cast("string"), F.when(years == 1, " work has").otherwise(" works have"),
        " SBN editions in more than 50 years, so the earliest edition shown is the earliest of the 50 SBN reports",
    )
    return F.concat(
        F.coalesce(F.flatten(F.transform("names", of_name)), F.array().cast("array<string>")),
        some(part("wikidata", "Wikidata works naming this person"), part("open_library", "Open Library works under this name")),
        each(F.col("unlinked"), unread), some(date_line(F.col("dates"), "records filed under no work"), F.when(years > 0, late)),
    )

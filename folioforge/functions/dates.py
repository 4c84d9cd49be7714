"""Years and dates of catalogue statements, and the rule that settles a record's year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notes on a year, from the least certain on.
SEVERITY = ["unchecked", "unsure", "other calendar", "inferred", "printed", "no date"]
# The first year of printing, and the patterns of years, brackets, calendars and printings.
EARLIEST = 1450
YEAR = r"(?<![0-9])([12][0-9]{3})(?![0-9])"
BRACKETS = r"[\[<]([^\]>]*)[\]>]"
MARK = r"(?<!\d)[12]\d{3}\s?(?:A\.?\s?H\.?|H|h|s|eg|ʻĀ\.\s?Me|E\.\s?C)(?=$|\.|[\s/\[\(,;])(?!\.[\p{L}])"
PRINTING = r"(?i)\b(?:stampa|ristampa|rist\.|impr\.|printed|printing)\s*(?:\d{4}|\[\d{4}\])"
RANGE = r"^\s*(\d{4})\s*-\s*(\d{4})\s*$"


def year_of(value: Column) -> Column:
    """The first year 1000 to 2099 in any text."""
    return F.nullif(F.regexp_extract(value, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1), F.lit("")).cast("int")


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def printing_years(statement: Column) -> Column:
    """The years that a printing statement names."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(f"({PRINTING})"), F.lit(1)), years)))


def _without_spans(text: Column) -> Column:
    """A run of years, and a pair of consecutive ones, as the first of them."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<!\d)([12]\d{3}\s?-\s?[12]\d{3})(?!\d)"), F.lit(1))
    pairs = F.regexp_extract_all(text, F.lit(r"(?<!\d)([12]\d{3}(?:\s?/\s?|\so\s|\sor\s)[12]\d{3})(?!\d)"), F.lit(1))
    first, last = (lambda s: F.substring(s, 1, 4).cast("int")), (lambda s: F.right(s, F.lit(4)).cast("int"))
    shorten = lambda acc, s, ok: F.when(ok, F.replace(acc, s, F.substring(s, 1, 4))).otherwise(acc)
    text = F.aggregate(runs, text, lambda acc, s: shorten(acc, s, first(s) < last(s)))
    return F.aggregate(pairs, text, lambda acc, s: shorten(acc, s, first(s) + 1 == last(s)))


def candidates(statement: Column) -> Column:
    """Publication years in order, without those of printings."""
    bare = F.regexp_replace(F.coalesce(statement, F.lit("")), PRINTING, " ")
    return F.array_distinct(years(_without_spans(bare)))


def bracketed(statement: Column) -> Column:
    """Publication years inside brackets."""
    inside = F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(BRACKETS), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inside, candidates)))


def indexed_years(values: Column) -> Column:
    """Index values as years: a year, or both ends of a range; any other value is none."""
    ends = lambda v: F.array(F.regexp_extract(v, RANGE, 1), F.regexp_extract(v, RANGE, 2))
    years_ = lambda v: F.when(v.rlike(RANGE), ends(v)).when(v.rlike(r"^\s*\d+\s*$"), F.array(F.trim(v))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(values, lambda v: years_(v).cast("array<int>"))))


def gregorian(year: Column, this_year: int) -> Column:
    return year.between(EARLIEST, this_year + 1)


def is_plain(statement: Column, this_year: int) -> Column:
    """One plausible year and no calendar's mark."""
    c = candidates(statement)
    return F.coalesce((F.size(c) == 1) & gregorian(F.try_element_at(c, F.lit(1)), this_year) & ~statement.rlike(MARK), F.lit(False))


def covers(value: Column, year: Column) -> Column:
    """Is a year an index value, or inside its range."""
    low, high = (F.regexp_extract(value, RANGE, i).try_cast("int") for i in (1, 2))
    return F.when(value.rlike(RANGE), year.between(low, high)).otherwise(F.trim(value) == year.cast("string"))


def needs_check(source: Column, statement: Column, this_year: int) -> Column:
    """A national-catalogue record with a date that isn't plain."""
    return (source == "SBN") & (F.coalesce(statement, F.lit("")) != "") & ~is_plain(statement, this_year)


def plain_year(statement: Column, this_year: int) -> Column:
    return F.when(is_plain(statement, this_year), F.try_element_at(candidates(statement), F.lit(1)))


def settle_rows(rows: DataFrame, year: str, statement: str, indexed: str, failed: str, this_year: int, name: str = "settled") -> DataFrame:
    """``rows`` with a struct (year, note, shown) by the decision table; the first row that holds decides.

    ``indexed`` is null where the index was never asked and empty where it had nothing.
    What the rows of the table share is computed once, in columns of its own.
    """
    text = F.coalesce(statement, F.lit(""))
    parts = rows.withColumns({"__c": candidates(text), "__b": bracketed(text), "__p": printing_years(text), "__i": F.coalesce(indexed_years(F.col(indexed)), F.array().cast("array<int>")), "__m": text.rlike(MARK)})
    c, idx, first = F.col("__c"), F.col("__i"), F.try_element_at("__c", F.lit(1))
    parts = parts.withColumns({
        "__plain": F.coalesce((F.size(c) == 1) & gregorian(first, this_year) & ~F.col("__m"), F.lit(False)), "__in": F.array_intersect(c, idx),
        "__all": F.array_sort(F.array_distinct(F.concat(c, idx))).cast("array<string>"), "__printed": F.array_sort(F.array_intersect("__p", "__i")).cast("array<string>"),
    })
    none, null, plain, all_ = F.array().cast("array<string>"), F.lit(None), F.col("__plain"), F.col("__all")
    asked = F.col(indexed).isNotNull() & ~F.coalesce(failed, F.lit(False))
    has, has_year = text != "", F.coalesce(year, F.lit("")) != ""
    out = lambda y, note, shown: F.struct(y.cast("string").alias("year"), F.lit(note).cast("string").alias("note"), shown.alias("shown"))
    unbracketed = (F.size(c) == 1) & F.col("__m") & (F.size("__b") == 0)
    got = (
        F.when(~has & has_year, out(F.col(year), None, none))
        .when(~has, out(null, "no date", none))
        .when(plain & (~asked | F.array_contains(idx, first)), out(first, None, none))
        .when(plain & (F.size("__printed") > 0), out(first, "printed", F.col("__printed")))
        .when(plain, out(null, "unsure", all_))
        .when(F.size(c) == 0, out(null, "unsure", F.array(text)))
        .when(asked & F.array_contains(idx, first) & (F.size(F.array_except("__b", "__i")) == 0), out(first, None, none))
        .when(asked & (F.size("__in") == 1) & (F.col("__in")[0] != first), out(F.col("__in")[0], "inferred", none))
        .when(F.coalesce(failed, F.lit(False)), out(null, "unchecked", all_))
        .when(~F.exists(c, lambda y: gregorian(y, this_year)) | unbracketed, out(null, "other calendar", all_))
        .otherwise(out(null, "unsure", all_))
    )
    return parts.withColumn(name, got).drop("__c", "__b", "__p", "__i", "__m", "__plain", "__in", "__all", "__printed")


def severity(note: Column) -> Column:
    """0 for the least certain note; null without one."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), note), F.lit(0)) - 1


def stated_when(year: Column, precision: Column) -> Column:
    """A year, decade or century by its precision (9, 8, 7); years before the era are negative."""
    era = F.when(year < 0, " BCE").otherwise("")
    n = F.abs(year)
    century = F.ceil(n / 100).cast("int")
    teen, last = F.pmod(century, F.lit(100)).between(11, 13), F.pmod(century, F.lit(10))
    ordinal = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return (
        F.when(precision >= 9, F.concat(n.cast("string"), era))
        .when(precision == 8, F.concat(F.lit("in the "), (F.floor(n / 10) * 10).cast("string"), F.lit("s"), era))
        .when(precision == 7, F.concat(F.lit("in the "), century.cast("string"), ordinal, F.lit(" century"), era))
    )

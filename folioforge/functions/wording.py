"""What a lookup says about itself: Columns that fill fixed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of notes and labels.
INCOMPLETE = (
    "Incomplete: %s %s failed, so editions are probably missing — a whole language can drop out this way. "
    "Everything that did arrive is cached, so running the same search again is fast and usually fills the gaps."
)
SLOW_UNEXPLAINED = "Slow lookup (%s s), though no request in it went to the network."
SLOW = (
    "Slow lookup (%s s). Measured in it: %s. Request times are summed across requests that ran in parallel, "
    "so they can add up to more than the lookup took."
)
YEAR_LABELS = {
    "inferred": "year inferred", "printed": "printed %s", "unsure": "year unsure", "unchecked": "year unchecked", "other calendar": "other calendar",
    "no date": "no year",
}
YEAR_DETAILS = {
    "inferred": "The year both agree on is shown.", "printed": "SBN files it under the printing; the year shown is the publication's.",
    "unchecked": "SBN could not be asked.", "other calendar": "Another calendar; not converted.",
}
UNSURE_DETAILS = ("They do not agree on one year.", "SBN's index gives none of these years.", "Nothing to check it against.")
NO_YEAR_DETAIL = "The catalogue gives no year."
AUTHOR_ADOPTED = "author from %s — none was typed"
SHARED_TITLE = "%s books are called “%s” — pick one"


def number(n: Column) -> Column:
    """A whole number with thousands parted by commas."""
    return F.format_number(F.coalesce(n, F.lit(0)).cast("long"), 0)


def quoted(text: Column) -> Column:
    """In single quotes, or double ones around an apostrophe."""
    mark = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")
    return F.concat(mark, text, mark)


def listed(names: Column) -> Column:
    """'a, b and c'."""
    most = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")
    return F.when(F.size(names) > 1, F.concat(most, F.lit(" and "), F.element_at(names, -1))).otherwise(F.array_join(names, ""))


def read_of(read: Column, total: Column, what: Column | str) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    of = F.when(F.coalesce(total, F.lit(0)) > 0, F.concat(F.lit(" of "), number(total))).otherwise("")
    return F.concat(F.lit("read "), number(read), of, F.lit(" "), what)


def incomplete(failed: Column) -> Column:
    """The note of a lookup with failed requests; null without any."""
    return F.when(failed > 0, F.format_string(INCOMPLETE, failed.cast("string"), F.when(failed == 1, "request").otherwise("requests")))


def slow(elapsed: Column, causes: Column, threshold: float) -> Column:
    """The note of a lookup over the threshold, with the causes that were measured."""
    seconds = F.format_string("%.0f", elapsed.cast("double"))
    told = F.when(F.size(causes) > 0, F.format_string(SLOW, seconds, F.array_join(causes, "; "))).otherwise(F.format_string(SLOW_UNEXPLAINED, seconds))
    return F.when(elapsed > threshold, told)


def year_label(note: Column, years: Column) -> Column:
    """The short label of a year that wasn't taken as written."""
    out = F.lit(None).cast("string")
    for name, text in YEAR_LABELS.items():
        out = F.when(note == name, F.format_string(text, F.array_join(years, ", ")) if "%s" in text else F.lit(text)).otherwise(out)
    return out


def year_detail(note: Column, statements: Column, indexed: Column, asked: Column) -> Column:
    """What the catalogue wrote, what the index said, and what follows."""
    disagree, none, unchecked = UNSURE_DETAILS
    unsure = F.when(F.size(indexed) > 0, disagree).when(asked, none).otherwise(unchecked)
    last = F.when(note == "unsure", unsure)
    for name, text in YEAR_DETAILS.items():
        last = last.when(note == name, text)
    wrote = F.concat(F.lit("Catalogue: "), F.array_join(statements, "; "), F.lit("."))
    index = F.when(F.size(indexed) > 0, F.concat(F.lit("SBN index: "), F.array_join(indexed, ", "), F.lit(".")))
    return F.when(note == "no date", NO_YEAR_DETAIL).when(note.isNotNull(), F.concat_ws(" ", wrote, index, last))


def author_adopted(sources: Column) -> Column:
    return F.format_string(AUTHOR_ADOPTED, listed(F.array_sort(sources)))


def books_share_title(count: Column, title: Column) -> Column:
    return F.format_string(SHARED_TITLE, count.cast("string"), title)

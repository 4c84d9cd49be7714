"""ISBN functions: check digits, 10 to 13, extraction from raw strings, store links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(code: Column, i: Column) -> Column:
    return F.try_to_number(F.substring(code, i, F.lit(1)), F.lit("9")).cast("int")


def check13(first12: Column) -> Column:
    """The 13th digit, as text."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda acc, i: acc + _digit(first12, i) * F.when(i % 2 == 1, 1).otherwise(3))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def check10(first9: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda acc, i: acc + _digit(first9, i) * (11 - i))
    rest = F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def valid(code: Column) -> Column:
    ten = code.rlike("^[0-9]{9}[0-9X]$") & (F.substring(code, 10, 1) == check10(code))
    return F.coalesce(F.when(F.length(code) == 10, ten).otherwise(code.rlike("^[0-9]{13}$") & (F.substring(code, 13, 1) == check13(code))), F.lit(False))


def to_isbn13(code: Column) -> Column:
    first = F.concat(F.lit("978"), F.substring(code, 1, 9))
    return F.when(F.length(code) == 13, code).otherwise(F.concat(first, check13(first)))


def isbns_in(values: Column) -> Column:
    """Distinct ISBN-13 codes of raw strings in order; separators go, codes with a wrong check digit stay."""
    joined = F.transform(values, lambda v: F.regexp_replace(F.upper(v), r"(?<=[0-9])[\s\-‐-―.]+(?=[0-9X])", ""))
    codes = F.flatten(F.transform(joined, lambda v: F.regexp_extract_all(v, F.lit(r"(?<![0-9A-Z])((?:97[89][0-9]{10})|(?:[0-9]{9}[0-9X]))(?![0-9A-Z])"), F.lit(1))))
    return F.array_distinct(F.transform(codes, to_isbn13))


def isbn_keys(isbn: Column, isbns_raw: Column) -> Column:
    """The codes a record is joined by."""
    return F.array_sort(F.array_distinct(F.concat(isbns_in(F.coalesce(isbns_raw, F.array().cast("array<string>"))), isbns_in(F.array_compact(F.array(isbn))))))


def links(isbn: Column, stores: list[tuple[str, str]]) -> Column:
    """(store, url) search links of an ISBN; none without one."""
    made = F.array(*[F.struct(F.lit(name).alias("store"), F.concat(F.lit(prefix), F.url_encode(isbn)).alias("url")) for name, prefix in stores])
    return F.when(isbn.isNotNull(), made)

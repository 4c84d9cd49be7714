from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioforge.functions import dates, imprint, isbn, langs, publishers, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v if isinstance(v, str) else 'string'}" for k, v in ((k, "string") for k in values))) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("title", "tokens"), [
    ("Il nome della rosa", ["nome", "rosa"]), ("Доктор Живаго", ["doktor", "zhivago"]), ("", []), (None, []), ("L'été à Paris", ["ete", "paris"]),
    ("Ὀδύσσεια", ["odysseia"]), ("the of", []), ("東京", []),
])
def test_tokens(title, tokens):
    assert text.tokens_of(title) == tokens


def test_folding_brings_romanisations_together(spark):
    rows = spark.createDataFrame([("zhivago", "zivago"), ("odysseia", "odyssea"), ("dostoevskij", "dostoevsky"), ("shchedrin", "sedrin"), ("tsar", "czar")], "a string, b string")
    got = [r[0] == r[1] for r in rows.select(text.fold_variants(F.col("a")), text.fold_variants(F.col("b"))).collect()]
    assert got == [True, True, False, True, False]


def test_titles_and_names(spark):
    row = spark.createDataFrame([("War: a - b", "a — b - c", "Eco, Umberto <1932->", "{Opere}2. Saggi", "T / by X", "Лев")], "a string, b string, c string, d string, e string, f string")
    got = row.select(
        text.core_title(F.col("a")), text.core_title(F.col("b")), text.author_display(F.col("c")), text.surname(F.col("c")), text.volume_title(F.col("d")),
        text.title_of(F.col("e")), text.statement_of(F.col("e")), text.is_latin(F.col("f")), text.romanise(F.col("f")), text.fold_case(F.lit("Straße É")),
    ).first()
    assert list(got) == ["War", "a — b", "Umberto Eco", "Eco", "Opere. 2. Saggi", "T", "by X", False, "Lev", "strasse e"]


def test_isbn(spark):
    rows = spark.createDataFrame([(["88-06-12345-X", "ISBN 978 88 452 0000 1", "080442957X and 9780306406157"],), ([],)], "v array<string>")
    got = [r[0] for r in rows.select(isbn.isbns_in(F.col("v"))).collect()]
    assert got[1] == [] and "9780804429573" in got[0] and "9780306406157" in got[0] and "9788845200001" in got[0]
    ok = spark.createDataFrame([("9780306406157",), ("9780306406158",), ("080442957X",), ("0804429570",), ("x",)], "c string")
    assert [r[0] for r in ok.select(isbn.valid(F.col("c"))).collect()] == [True, False, True, False, False]


@pytest.mark.parametrize(("year", "statement", "indexed", "failed", "expected"), [
    ("1980", None, None, False, ("1980", None)), (None, None, None, False, (None, "no date")), (None, "1980", None, False, ("1980", None)),
    (None, "1980", ["1980"], False, ("1980", None)), (None, "1980", ["1984"], False, (None, "unsure")), (None, "1996, stampa 1997", ["1997"], False, ("1996", "printed")),
    (None, "s.d.", None, False, (None, "unsure")), (None, "1980 1985", ["1985"], False, ("1985", "inferred")), (None, "1980 1985", ["1980"], False, ("1980", None)),
    (None, "1980 1985", [], True, (None, "unchecked")), (None, "1333 h.", None, False, (None, "other calendar")), (None, "1386 [2007]", ["2007"], False, ("2007", "inferred")),
    (None, "1988-2006", None, False, ("1988", None)), (None, "[2004/2005]", None, False, ("2004", None)),
])
def test_settle(spark, year, statement, indexed, failed, expected):
    row = spark.createDataFrame([(year, statement, indexed, failed)], "y string, s string, i array<string>, f boolean")
    got = dates.settle_rows(row, "y", "s", "i", "f", 2026).first()["settled"]
    assert (got["year"], got["note"]) == expected


def test_index_values(spark):
    row = spark.createDataFrame([(["2007", " 1977 - 1991 ", "ca 1977 x", "199u"], "1980 1990", "1980-1990")], "v array<string>, a string, b string").select(
        dates.indexed_years(F.col("v")), dates.covers(F.col("a"), F.lit(1985)), dates.covers(F.col("b"), F.lit(1985)), dates.covers(F.col("a"), F.lit(1980)), dates.bracketed(F.lit("1386 [2007, 2008] <1999>")),
        dates.needs_check(F.lit("SBN"), F.lit("[1999?] 2001"), 2026), dates.needs_check(F.lit("SBN"), F.lit("1999"), 2026), dates.plain_year(F.lit("c1999"), 2026),
    ).first()
    assert list(row) == [[2007, 1977, 1991], False, True, False, [2007, 2008, 1999], True, False, 1999]


def test_stated_when(spark):
    rows = spark.createDataFrame([(1320, 8), (1850, 7), (1999, 9), (-20, 9), (1900, 6), (1101, 7)], "y int, p int")
    assert [r[0] for r in rows.select(dates.stated_when(F.col("y"), F.col("p"))).collect()] == ["1999"] * 0 + ["in the 1320s", "in the 19th century", "1999", "20 BCE", None, "in the 12th century"]


@pytest.mark.parametrize(("raw", "expected"), [
    ("Milano : Bompiani, 1980", ("Bompiani", "1980", "Milano")), ("Torino : Einaudi, [1994]", ("Einaudi", "1994", "Torino")), ("157 p. ; 21 cm", (None, None, None)),
    ("Ankara : 1001 Çiçek kitaplar, 2015", ("1001 Çiçek kitaplar", "2015", "Ankara")), ("2. ed. Milano : Mondadori, 1950", ("Mondadori", "1950", "Milano")),
    ("Milano : Bompiani, [19..]", ("Bompiani", None, "Milano")), ("Palermo : Sellerio, [198.?]", ("Sellerio", None, "Palermo")), ("Milano : A. Mondadori, 2. rist. 1990", ("A. Mondadori", "1990", "Milano")),
    ("Yerushalaim : Kitab, c5760 [i.e. 1999/00]", ("Kitab", "1999", "Yerushalaim")), ("1 compact disc", (None, None, None)), ("Torino : Einaudi. - volumi 3", ("Einaudi", None, "Torino")),
    ("[Los Angeles : Virgin records America, CA], 1997", ("Virgin records America, CA", "1997", "Los Angeles")), ("R. Piper & Co., München: 1980", ("R. Piper & Co., München", "1980", None)),
    (", 154. ed. ; Paris : Gallimard, 1929 [ristampa 1949]", ("Gallimard", "1929", "Paris")), ("Edizione abbreviata, Milano : Hoepli, 1893", ("Hoepli", "1893", "Edizione abbreviata, Milano")),
    ("Torino : Einaudi, [197...] ; Edito : Ginevra, [197...]", ("Einaudi ; Edito : Ginevra", None, "Torino")), ("12. rist", (None, None, None)), (", [tra il 1970 e il 1990]", (None, "1970", None)),
    ("Roma : Laterza, s.d.", ("Laterza", None, "Roma")), ("Roma : Rizzoli, dopo il 1920", ("Rizzoli", "1920", "Roma")), (None, (None, None, None)),
])
def test_imprint(raw, expected):
    assert imprint.parse(raw)[:3] == expected


@pytest.mark.parametrize(("raw", "expected"), [
    ("Tihran : Aryaban, 1386 [2007!", "1386 [2007]"), ("Torino : Einaudi, 1971, stampa 1978 - 221 p. ; 20 cm.", "1971, stampa 1978"), ("Roma : X, [tra il 1970 e il 1990]", "[tra il 1970 e il 1990]"), ("Roma : X", None),
])
def test_date_statement(raw, expected):
    assert imprint.parse(raw)[3] == expected


def test_names_and_labels(spark):
    row = spark.createDataFrame([(["[Autore]  Rossi", "Bianchi", " "], "Einaudi : Utet ; Roma : Laterza ; in association with Secker", ["A ; B", "C : D"])], "n array<string>, p string, q array<string>").select(
        imprint.labelled(F.col("n")), publishers.publisher_names(F.col("p")), publishers.listed_publishers(F.col("q")),
    ).first()
    assert [tuple(x) for x in row[0]] == [("Autore", "Rossi"), ("", "Bianchi")] and row[1] == ["Einaudi", "Utet", "Laterza", "Secker"] and row[2] == ["A", "B", "C", "D"]


@pytest.mark.parametrize("title", ["L’été à Paris", "Łódź æ ß Ø İstanbul", "e\u0301cole ﬁn", "Ὀδύσσεια x", "NAÏVE ½ ª", "北京 abc", "a–b…c"])
def test_tokens_are_the_same_in_both_ways(spark, title):
    got = spark.createDataFrame([(title,)], "t string").select(text.normalize("t")).first()[0]
    assert got == text.tokens_of(title)


def test_publishers(spark):
    assert publishers.key_of("Giulio Einaudi editore") == ["einaudi", "giulio"] and publishers.key_of("Edizioni e/o") == ["eo"] and publishers.key_of("Press & Co.") == []
    a = spark.createDataFrame([([["einaudi"]], [["einaudi", "giulio"]], [100], [105]), ([["einaudi"]], [["laterza"]], [100], [150]), ([[]], [["x"]], [], [1])], "a array<array<string>>, b array<array<string>>, p array<int>, q array<int>")
    got = [tuple(r) for r in a.select(publishers.publisher_agrees(F.col("a"), F.col("b")), publishers.pages_disagree(F.col("p"), F.col("q"))).collect()]
    assert got == [(True, False), (False, True), (False, False)]


def test_languages(spark):
    row = spark.range(1).select(
        langs.from_label(F.lit("Italiano - Inglese")), langs.from_label(F.lit("?")), langs.from_code(F.lit("und")), langs.from_code(F.lit("fr")), langs.from_key(F.lit("/languages/ita")),
        langs.from_two_letter(F.lit("pt-br")), langs.from_item(F.lit("Q652")), langs.display(F.lit("kor")), langs.display(F.lit("xxx")), langs.two_letter(F.lit("ita")),
    ).first()
    assert list(row) == ["ita", "unknown", "unknown", "fre", "ita", "por", "ita", "coreano", "xxx", "it"]

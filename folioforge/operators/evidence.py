"""Labels and contradictions: who a record is credited to, what its language says, which people a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.langs import UNKNOWN, is_latin_script
from folioforge.functions.text import author_display, names_agree, script_contradicts

# Words of a statement that name another language, and adaptation media of uniform titles.
TRANSLATED = r"(?i)\b(translated (?:from|by)|tradotto dal|tradotta dal|traduit (?:du|par)|traducido del|ubersetzt|übersetzt)\b"
ADAPTATIONS = r"(?i)<\s*(film|serie tv|fumetto|opera|musical|videogioco)"
FACET_CAP = 50


def medium_of(label: Column) -> Column:
    """The adaptation medium that a uniform title's qualifier names."""
    return F.nullif(F.lower(F.regexp_extract(label, ADAPTATIONS, 1)), F.lit(""))


def has_translation_evidence(translators: Column, evidence: Column) -> Column:
    return (F.coalesce(F.size(translators), F.lit(0)) > 0) | (F.coalesce(F.size(evidence), F.lit(0)) > 0)


def language_contradicts_itself(language: Column, original: str | None, translators: Column, statement: Column) -> Column:
    """Claims the original's language and names a translator or what it was translated from."""
    claims = F.lit(original is not None) & (language == F.lit(original))
    return F.coalesce(claims & ((F.coalesce(F.size(translators), F.lit(0)) > 0) | F.coalesce(statement.rlike(TRANSLATED), F.lit(False))), F.lit(False))


def place_language(rows: DataFrame, title: str, language: str) -> tuple[DataFrame, DataFrame]:
    """(rows, notes): a language of Latin script whose title isn't in it becomes unknown, with a note."""
    wrong = is_latin_script(F.col(language)) & F.coalesce(script_contradicts(F.col(title)), F.lit(False))
    notes = rows.where(wrong).select("*", F.lit("script").alias("reason"))
    return rows.withColumn(language, F.when(wrong, UNKNOWN).otherwise(F.col(language))), notes


def credited_to_another(authors: Column, author_tokens: Column, form_tokens: Column) -> Column:
    """The main author's display name when it agrees with none of the known forms (arrays of token arrays)."""
    known = F.exists(form_tokens, lambda f: names_agree(author_tokens, f))
    return F.when((F.size(authors) > 0) & (F.size(form_tokens) > 0) & ~known, author_display(authors[0]))


def work_language_contradicted(records: DataFrame, work: str, affinity: str, same_letters: str, threshold: float = 0.6) -> DataFrame:
    """(work, contradicted): records in the stated language exist, and none that isn't a translation carries the work's title.

    Rows are the records filed under the stated language: ``affinity`` to the work's
    title, ``translated``, and ``same_letters``, whether the titles agree without blanks.
    """
    carries = (F.col(affinity) >= threshold) | F.col(same_letters)
    own = records.where(~F.col("translated")).groupBy(work).agg(F.bool_or(carries).alias("carried"))
    return records.select(work).distinct().join(own, work, "left").select(work, (~F.coalesce("carried", F.lit(True))).alias("contradicted"))


def add_author(names: Column) -> Column:
    """Names in order, each person once: same letters count as one, and an accented spelling replaces a plain one.

    ``names``: array of struct(name, key) with key the folded token string.
    """
    none = F.array().cast("array<struct<name:string,key:string>>")

    def put(acc: Column, x: Column) -> Column:
        same = F.exists(acc, lambda y: y["key"] == x["key"])
        better = x["name"].rlike(r"[^\x00-\x7F]")
        swapped = F.transform(acc, lambda y: F.when((y["key"] == x["key"]) & better & ~y["name"].rlike(r"[^\x00-\x7F]"), x).otherwise(y))
        return F.when(same, swapped).otherwise(F.concat(acc, F.array(x)))

    return F.transform(F.aggregate(names, none, put), lambda y: y["name"])


def pick_authority(rows: DataFrame, question: str, form: str, exact: Column, within: Column, bare: Column) -> DataFrame:
    """One authority for each question, or none: forms in order; in a form equal names, then contained ones, then the only person.

    A rule decides only if it names a single authority; a bare surname never decides by containment.
    """
    rule = F.when(exact, 1).when(within & ~bare, 2).otherwise(3)
    people = rows.withColumn("rule", rule).select(question, form, "rule", "id").distinct()
    n_form = F.count("*").over(Window.partitionBy(question, form))
    n_rule = F.count("*").over(Window.partitionBy(question, form, "rule"))
    sole = people.withColumns({"people": n_form, "n": n_rule}).where((F.col("n") == 1) & ((F.col("rule") < 3) | (F.col("people") == 1)))
    first = F.row_number().over(Window.partitionBy(question).orderBy(form, "rule"))
    return sole.withColumn("p", first).where("p = 1").select(question, "id", form, "rule")


def order_people(people: DataFrame, resolved: str | None) -> DataFrame:
    """Resolved first, then agreeing names, most records, id."""
    return people.orderBy(~F.coalesce(F.col("id") == F.lit(resolved), F.lit(False)), ~F.col("agrees"), F.desc("records"), "id")


def closest(docs: DataFrame, question: str, n: int = 3) -> DataFrame:
    """The best-scoring refused documents of a question."""
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), F.desc("title")))
    return docs.withColumn("place", place).where(F.col("place") <= n)


def capped(facet: DataFrame, key: str) -> DataFrame:
    """(key, items, capped): a facet of 50 items may have been cut."""
    return facet.groupBy(key).agg(F.count("*").alias("items")).withColumn("capped", F.col("items") >= FACET_CAP)


def derived(entries: DataFrame, book: str) -> DataFrame:
    """Adaptations of a book: one row for a stated medium and year; unstated years stay apart."""
    key = F.when(F.col("stated"), F.concat_ws("|", "medium", F.col("year").cast("string"))).otherwise(F.col("id"))
    return entries.groupBy(book, key.alias("entry")).agg(F.min("medium").alias("medium"), F.min("year").alias("year"), F.sum("records").alias("records"))


def origin_phrase(original_year: Column, language_name: Column, first_seen: Column) -> Column:
    """How the origin is worded; a language is never paired with a year that was only seen."""
    return (
        F.when(original_year.isNotNull() & language_name.isNotNull(), F.concat(F.lit("first published in "), language_name, F.lit(", "), original_year.cast("string")))
        .when(original_year.isNotNull(), F.concat(F.lit("first published "), original_year.cast("string")))
        .when(language_name.isNotNull(), F.concat(F.lit("originally in "), language_name))
        .when(first_seen.isNotNull(), F.concat(F.lit("earliest edition found: "), first_seen.cast("string")))
    )

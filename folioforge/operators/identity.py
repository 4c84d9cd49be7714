"""Who and what a question means: items, works, authorities and documents judged, for many lookups at once.

Every frame has a ``lookup`` column; a position column keeps the order in which a
source answered, so each "first" is a window or ``min_by`` over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.functions.text import GATE, contained, is_latin, names_agree

# Classes of written works, the class of editions, and the reasons for which an item is refused.
WORK_CLASSES = [
    "Q571", "Q7725634", "Q47461344", "Q234460", "Q8261", "Q49084", "Q1279564", "Q5185279", "Q35760", "Q17537576", "Q386724", "Q3331189", "Q1667921",
    "Q13136", "Q2382443",
]
EDITION_CLASS = "Q3331189"
NOT_A_WORK, AN_EDITION, OTHER_AUTHOR = "not a written work", "an edition of a work, not the work", "author disagrees"
SOLE_PERSON_MAX = 1000
MOST_SPELLINGS = 6


# Predicates ---------------------------------------------------------------------------------


def is_edition(classes: Column) -> Column:
    return F.array_contains(classes, EDITION_CLASS)


def is_written_work(classes: Column, authors: Column, has_date: Column) -> Column:
    """Of a class of written works, or with an author and a date."""
    typed = F.arrays_overlap(classes, F.array(*[F.lit(x) for x in WORK_CLASSES]))
    return F.coalesce(typed, F.lit(False)) | (F.coalesce(F.size(authors) > 0, F.lit(False)) & has_date)


def item_is_work(typed: Column, edition: Column) -> Column:
    """Typed as a work and not an edition of one; an author's list takes no other item."""
    return F.coalesce(typed, F.lit(False)) & ~F.coalesce(edition, F.lit(False))


def author_matches(query: Column, candidates: Column) -> Column:
    """Token arrays: any candidate shares a token with the query; true without a query."""
    return F.when(F.coalesce(F.size(query), F.lit(0)) <= 0, True).otherwise(F.coalesce(F.exists(candidates, lambda c: F.arrays_overlap(c, query)), F.lit(False)))


def author_keys(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.when(k.startswith("/"), k).otherwise(F.concat(F.lit("/authors/"), k)))


def doc_author_agrees(doc_tokens: Column, doc_keys: Column, query: Column, keys: Column) -> Column:
    """'author name', 'author key' or null: how a document is by the author."""
    by_key = F.coalesce(F.arrays_overlap(author_keys(doc_keys), author_keys(keys)), F.lit(False))
    return F.when(author_matches(query, doc_tokens), "author name").when(by_key, "author key")


def same_name(a: Column, b: Column, a_surname: Column, b_surname: Column) -> Column:
    """Equal non-empty token sets, or surnames (token arrays) that agree."""
    equal = (F.size(a) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))
    return equal | names_agree(a_surname, b_surname)


def same_person(a: Column, b: Column) -> Column:
    return contained(a, b)


def surname_tokens(name: Column) -> Column:
    return text.normalize(text.surname(name))


def sendable(title: Column, author: Column) -> Column:
    """Both halves are there and in Latin script."""
    has = (F.coalesce(F.trim(title), F.lit("")) != "") & (F.coalesce(F.trim(author), F.lit("")) != "")
    return has & is_latin(title) & is_latin(author)


def probe_refusal(title: Column, author: Column) -> Column:
    """Why a free-text probe must not be sent; null if it may."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(empty(title) | empty(author), "no title or no author")
        .when(~(is_latin(title) & is_latin(author)), "not Latin script: the OPAC discards the term and answers with the unfiltered set (F15)")
        .when(F.contains(title, F.lit("/")), "a single '/' makes SBN's Solr answer 200 with an error and no records")
    )


def prepare(questions: DataFrame) -> DataFrame:
    """``questions`` (title, author) with the romanised title and author, and notes on what changed."""
    q = questions.withColumns({"typed_title": F.trim(F.coalesce("title", F.lit(""))), "typed_author": F.trim(F.coalesce("author", F.lit("")))})
    q = q.withColumns({"title": text.romanise("typed_title"), "author": text.romanise("typed_author")})

    def note(name: str) -> Column:
        typed, sent = F.col(f"typed_{name}"), F.col(name)
        changed = F.concat(F.lit(f"{name} romanised: "), typed, F.lit(" -> "), sent)
        refused = F.concat(F.lit(f"{name} is not in Latin script and is not sent: "), typed)
        return F.when(typed != sent, changed).when((typed != "") & ~is_latin(typed), refused)

    return q.withColumn("notes", F.array_compact(F.array(note("title"), note("author"))))


def spellings(rows: DataFrame, cap: int | None = MOST_SPELLINGS) -> DataFrame:
    """Of rows (lookup, title_key, pos, spelling, key): Latin spellings, each token set once and none the title's; the first ``cap``.

    ``key`` and ``title_key`` are sorted token arrays.
    """
    fit = rows.where((F.size("key") > 0) & is_latin(F.col("spelling")) & (F.col("key") != F.col("title_key")))
    once = fit.withColumn("p", F.row_number().over(Window.partitionBy("lookup", "key").orderBy("pos"))).where("p = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("lookup").orderBy("pos"))).drop("p", "title_key")
    return placed if cap is None else placed.where(F.col("place") <= cap)


# Picks --------------------------------------------------------------------------------------


def judge_items(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of item candidates: the first of a lookup that is a work, no edition, by the author and titled alike.

    Rows: lookup, pos, qid, written, edition, author_agrees, score, form.  Only what
    stands before the accepted item counts as rejected.
    """
    low = F.format_string("title %.2f < %s (closest %s)", "score", F.lit(str(GATE)), F.coalesce("form", F.lit("None")))
    reason = F.when(~F.col("written"), NOT_A_WORK).when(F.col("edition"), AN_EDITION).when(~F.col("author_agrees"), OTHER_AUTHOR).when(F.col("score") < GATE, low)
    marked = candidates.withColumn("reason", reason)
    first = marked.where("reason is null").groupBy("lookup").agg(F.min_by(F.struct("pos", "qid", F.round("score", 3).alias("score"), "form"), "pos").alias("item"))
    rejected = marked.where("reason is not null").join(first.select("lookup", F.col("item.pos").alias("end")), "lookup", "left")
    rejected = rejected.where(F.col("end").isNull() | (F.col("pos") < F.col("end"))).select("lookup", "pos", "qid", "reason")
    return first.select("lookup", "item.qid", "item.score", "item.form"), rejected


def accept_guards(guards: DataFrame) -> DataFrame:
    """(lookup, work, tier, via_second_signal, others): the first accepted uniform title, and further ones.

    Rows: lookup, pos, work, tier, agrees (the second signal).
    """
    rescued = F.col("agrees") & F.col("tier").isin("weak", "rejected")
    good = guards.where(F.col("work").isNotNull() & ((F.col("tier") == "strong") | rescued)).withColumn("via", F.col("agrees") & (F.col("tier") != "strong"))
    each = good.groupBy("lookup", "work").agg(F.min("pos").alias("pos"), F.min_by(F.struct("tier", "via"), "pos").alias("t"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "work", "t"))), lambda x: x)
    out = each.groupBy("lookup").agg(in_order.alias("w"))
    return out.select(
        "lookup", F.col("w")[0]["work"].alias("work"), F.col("w")[0]["t"]["tier"].alias("tier"), F.col("w")[0]["t"]["via"].alias("via_second_signal"),
        F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x["work"]).alias("others"),
    )


def pick_doc(docs: DataFrame) -> DataFrame:
    """(lookup, key, title, score, edition_count, by, others): the document that is the work.

    Rows: lookup, pos, key, title, score (affinity to the work's titles), edition_count,
    ``by`` (null: another author's).  The title decides, to three places, then the number
    of editions, then the place; others are the next four as they came.
    """
    rounded = F.round("score", 3)
    fit = docs.where(F.col("key").isNotNull() & F.col("by").isNotNull() & (F.col("score") >= GATE)).withColumns({"score": rounded, "edition_count": F.coalesce("edition_count", F.lit(0))})
    by = Window.partitionBy("lookup")
    ranked = fit.withColumn("p", F.row_number().over(by.orderBy(F.desc("score"), F.desc("edition_count"), "pos")))
    ranked = ranked.withColumn("q", F.row_number().over(by.orderBy(F.col("p") == 1, "pos")))
    rest = F.transform(F.array_sort(F.collect_list(F.when((F.col("p") > 1) & (F.col("q") <= 4), F.struct("pos", "key")))), lambda x: x["key"])
    best = lambda c: F.max(F.when(F.col("p") == 1, F.col(c))).alias(c)
    return ranked.groupBy("lookup").agg(*[best(c) for c in ("key", "title", "score", "edition_count", "by")], rest.alias("others"))


def offered_duplicates(docs: DataFrame, main: DataFrame) -> DataFrame:
    """Other records of a work that a reader may add: by the author, titled alike, not the main one, each key once.

    Rows as ``pick_doc``'s, with languages and year; ``main``: lookup, key.
    """
    fit = docs.where(F.col("key").isNotNull() & F.col("by").isNotNull() & (F.col("score") >= GATE)).join(main.select("lookup", "key"), ["lookup", "key"], "left_anti")
    once = fit.withColumn("p", F.row_number().over(Window.partitionBy("lookup", "key").orderBy("pos"))).where("p = 1")
    out = once.select("lookup", "key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("edition_count", F.lit(0)).alias("editions"), "year", F.round("score", 3).alias("score"), "by")
    place = F.row_number().over(Window.partitionBy("lookup").orderBy(F.desc("editions"), F.lower("title"), "key"))
    return out.withColumn("place", place)


def pick_person(rows: DataFrame) -> DataFrame:
    """(lookup, rule, form, id, duplicates, ambiguous): the one person that a name authority's rows mean.

    Rows: lookup, form_pos, form, n_tokens (of the form), id, pos, name_key (the heading's
    tokens), equal, contains, truncated.  Forms in order, each first by equal headings, then
    by headings that contain it; the first of these with any heading decides: one person,
    or none where two names share it or a bare surname met a cut answer.
    """
    each = rows.where("equal").withColumn("rule", F.lit(1)).unionByName(rows.where("contains").withColumn("rule", F.lit(2)))
    first = each.groupBy("lookup").agg(F.min(F.struct("form_pos", "rule")).alias("first"))
    held = each.join(first, "lookup").where((F.col("form_pos") == F.col("first.form_pos")) & (F.col("rule") == F.col("first.rule")))
    g = held.groupBy("lookup", "rule", "form").agg(
        F.count_distinct("name_key").alias("names"), F.max("n_tokens").alias("n_tokens"), F.bool_or("truncated").alias("truncated"),
        F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ids"),
    )
    bare = (F.col("n_tokens") < 2) & F.col("truncated")
    ids = F.transform("ids", lambda x: x["id"])
    sole = (F.col("names") == 1) & ~bare
    return g.select(
        "lookup", "rule", "form", F.when(sole, ids[0]).alias("id"), F.when(sole, F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).alias("duplicates"),
        (F.col("names") > 1).alias("ambiguous"),
    )


def one_person(rows: DataFrame, group: str, name_key: str) -> DataFrame:
    """Groups whose rows all bear one name."""
    return rows.groupBy(group).agg(F.count_distinct(name_key).alias("names")).where("names = 1").select(group)


def persons(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.trim(F.col(kind)) == "Persona")


def person_of(people: DataFrame) -> DataFrame:
    """(lookup, qid): the first person of whom a Latin name agrees with a form asked.

    Rows: lookup, pos, qid, agrees.
    """
    return people.where("agrees").groupBy("lookup").agg(F.min_by("qid", "pos").alias("qid"))


def resolve_people(answers: DataFrame, picked: DataFrame) -> DataFrame:
    """People reached by any form, which is resolved, and whether to skip the choice.

    answers: lookup, form_pos, form, id, heading, agrees.  picked: lookup, id (what the
    typed form resolves to, null if nothing).  Resolved is the picked one if it was
    reached, else the only agreeing one that another form than the typed one reached;
    the choice is skipped if there is one person in all.
    """
    found = answers.groupBy("lookup", "id").agg(
        F.min_by("heading", "form_pos").alias("heading"), F.transform(F.array_sort(F.collect_set(F.struct("form_pos", "form"))), lambda x: x["form"]).alias("forms"),
        F.bool_or("agrees").alias("agrees"), F.bool_or(F.col("agrees") & (F.col("form_pos") > 0)).alias("aliased"),
    )
    own = picked.select("lookup", F.col("id").alias("picked"))
    per = found.join(own, "lookup", "left").groupBy("lookup").agg(
        F.count("*").alias("people"), F.max(F.when(F.col("id") == F.col("picked"), F.col("id"))).alias("direct"),
        F.count_if("aliased").alias("n"), F.max(F.when(F.col("aliased"), F.col("id"))).alias("other"),
    )
    per = per.withColumn("resolved", F.coalesce("direct", F.when(F.col("n") == 1, F.col("other"))))
    per = per.select("lookup", "resolved", (F.col("resolved").isNotNull() & (F.col("people") == 1)).alias("skip"))
    return found.drop("aliased").join(per, "lookup").withColumn("is_resolved", F.coalesce(F.col("id") == F.col("resolved"), F.lit(False)))


def title_books(candidates: DataFrame) -> DataFrame:
    """(lookup, book, authors, title, first_year, editions, sources) of bare-title candidates grouped by person.

    Rows: lookup, pos, book (of ``components.containment_groups``), source, title, year,
    editions, author.  Names by first appearance, the first three; the commonest title,
    ties to the first in the alphabet; a candidate without a number counts one edition.
    """
    once = candidates.groupBy("lookup", "book", "pos").agg(F.first("source").alias("source"), F.first("title").alias("title"), F.first("year").alias("year"), F.first("editions").alias("editions"))
    total = once.groupBy("lookup", "book").agg(F.min("year").alias("first_year"), F.sum(F.coalesce("editions", F.lit(1))).alias("editions"), F.sort_array(F.collect_set("source")).alias("sources"))
    n = once.groupBy("lookup", "book", "title").agg(F.count("*").alias("n"))
    title = n.groupBy("lookup", "book").agg(F.min_by("title", F.struct(-F.col("n"), "title")).alias("title"))
    names = candidates.groupBy("lookup", "book", "author").agg(F.min("pos").alias("p"))
    names = names.groupBy("lookup", "book").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p", "author"))), lambda x: x["author"]), 1, 3).alias("authors"))
    key = ["lookup", "book"]
    return total.join(title, key).join(names, key)


def second_signal(pairs: DataFrame) -> DataFrame:
    """(lookup, agrees, score, form) of a uniform title against the accepted item's forms; rows: lookup, score, form."""
    best = pairs.groupBy("lookup").agg(F.max(F.struct("score", "form")).alias("m"))
    return best.select("lookup", (F.col("m.score") >= GATE).alias("agrees"), F.col("m.score").alias("score"), F.col("m.form").alias("form"))


def worst(states: Column) -> Column:
    """The first state of an array that isn't ok."""
    return F.coalesce(F.try_element_at(F.filter(states, lambda s: s != "ok"), F.lit(1)), F.lit("ok"))

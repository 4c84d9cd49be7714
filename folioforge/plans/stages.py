"""The stages of a lookup over recorded answers, for many lookups at once.

Every frame has a ``lookup`` column, so a stage is one plan for all of them: sources'
answers come as frames (each row with its ``pos``, the place it came in), stages give
sightings (SIGHTING) and an evidence frame of one row a lookup.  Caps are those of the
sources' own limits, kept with how much they cut.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import dates, text
from folioforge.functions.langs import UNKNOWN, is_latin_script
from folioforge.functions.text import GATE
from folioforge.operators import gates, identity, ledger, simjoin, store
from folioforge.operators.evidence import language_contradicts_itself

#: What a sighting carries beside its own fields.
SIGHTING = ["lookup", "source", "id", "seq", "route", "evidence", "score", "via", "refused"]
# How many a stage reads of each kind.
ISBN_PROBES, REVERSE_READ, ENRICH_CAP, DATE_CAP, RECONCILE_CAP, YEAR_FACET = 12, 25, 1500, 300, 60, 50
ROUTES = ["work listing", "work editions", "title probe", "author sweep", "isbn probe", "full record", "duplicate work"]


def union(*frames: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sighted(rows: DataFrame, source: str | None, route: str, evidence: str | Column, score: Column | None = None, via: Column | None = None, stage: int = 0) -> DataFrame:
    """Rows as sightings; ``seq`` orders them by stage and place."""
    evidence = F.lit(evidence) if isinstance(evidence, str) else evidence
    out = rows if source is None else rows.withColumn("source", F.lit(source))
    return out.withColumns({
        "seq": F.lit(stage).cast("long") * (1 << 40) + F.col("pos"), "route": F.lit(route), "evidence": evidence, "score": F.lit(None).cast("double") if score is None else score,
        "via": F.lit(None).cast("string") if via is None else via, "refused": evidence == "refused",
    }).drop("pos")


def placed(sightings: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sightings, notes): a language that the record itself contradicts becomes unknown, with a note.

    It names a translator while claiming the work's original language, or its title isn't
    in a script of its language.
    """
    s = sightings.join(works.select("lookup", "original_language"), "lookup", "left")
    itself = F.coalesce(F.col("language") == F.col("original_language"), F.lit(False)) & language_contradicts_itself(F.col("language"), None, F.col("translators"), F.col("statement"))
    translated = (F.coalesce(F.size("translators"), F.lit(0)) > 0) | F.coalesce(F.size("translation_evidence") > 0, F.lit(False))
    itself = itself | F.coalesce(F.col("language") == F.col("original_language"), F.lit(False)) & translated
    script = is_latin_script(F.col("language")) & F.coalesce(text.script_contradicts(F.col("title")), F.lit(False))
    why = F.when(itself, "names a translator while claiming the work's original language").when(script, "the title is not in a script that language is written in")
    marked = s.withColumn("why", why)
    notes = marked.where("why is not null").select("lookup", F.col("id").alias("record"), "language", "why", "seq")
    return marked.withColumn("language", F.when(F.col("why").isNotNull(), UNKNOWN).otherwise(F.col("language"))).drop("why", "original_language"), notes


# S1 -----------------------------------------------------------------------------------------


def identify(questions: DataFrame, items: DataFrame, guards: DataFrame, docs: DataFrame, people: DataFrame, item_facts: DataFrame) -> DataFrame:
    """One row a question: the work, or what wasn't found of it.

    items, guards, docs, people: as ``identity.judge_items``, ``accept_guards``,
    ``pick_doc`` and ``pick_person`` take them (a guard's ``agrees`` is the second signal
    of the accepted item).  item_facts: qid, original_title, original_language,
    original_year, titles (map), item_authors.
    """
    item, rejected = identity.judge_items(items)
    facts = item.select("lookup", "qid", F.col("score").alias("item_score"), F.col("form").alias("item_form")).join(item_facts, "qid", "left")
    work = identity.accept_guards(guards).select("lookup", F.col("work").alias("sbn_work"), F.col("tier").alias("sbn_tier"), "via_second_signal", F.col("others").alias("sbn_others"))
    doc = identity.pick_doc(docs).select("lookup", F.col("key").alias("ol_key"), F.col("title").alias("ol_title"))
    person = identity.pick_person(people).select("lookup", F.col("id").alias("author_id"))
    refused = rejected.groupBy("lookup").agg(F.count("*").alias("items_refused"), F.min_by("reason", "pos").alias("first_refusal"))
    q = questions
    for part in (facts, work, doc, person, refused):
        q = q.join(part, "lookup", "left")
    known = F.col("qid").isNotNull() | F.col("sbn_work").isNotNull() | F.col("ol_key").isNotNull()
    stated = F.when(F.col("qid").isNotNull(), "Wikidata").otherwise("")
    return q.withColumns({"identified": known, "stated_by": stated})


def work_titles(works: DataFrame) -> DataFrame:
    """(lookup, pos, title): every title a work is known by, each once whatever its case: original, by language, the documents', uniform titles."""
    none = F.array().cast("array<string>")
    by_language = F.coalesce(F.transform(F.array_sort(F.map_entries("titles")), lambda e: e["value"]), none)
    all_ = F.concat(F.array("original_title"), by_language, F.array("ol_title", "sbn_work"), F.coalesce("sbn_others", none))
    each = works.select("lookup", F.posexplode(all_).alias("pos", "title")).where("coalesce(title, '') <> ''")
    return each.withColumn("p", F.row_number().over(Window.partitionBy("lookup", F.lower("title")).orderBy("pos"))).where("p = 1").drop("p")


# S2 -----------------------------------------------------------------------------------------


def list_editions(works: DataFrame, listing: DataFrame, whole: DataFrame, editions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sightings, notes, evidence) of the two catalogues' listings.

    listing: the language pages' rows (lookup, work, page, pos, id, language, ...), pages
    in facet order; a record on several pages counts on its first.  whole: the unfiltered
    pass (lookup, pos, id, ...), of which only missing ids join, without a language.
    editions: the other catalogue's, by the work's key (lookup, key, pos, id, ...).
    """
    wanted = works.select("lookup", F.explode(F.concat(F.array("sbn_work"), F.coalesce("sbn_others", F.array().cast("array<string>")))).alias("work")).where("work is not null")
    pages = listing.join(wanted, ["lookup", "work"], "left_semi")
    once = pages.withColumn("p", F.row_number().over(Window.partitionBy("lookup", "id").orderBy("page", "pos"))).where("p = 1").drop("p", "work", "page")
    missing = whole.join(wanted.select("lookup").distinct(), "lookup", "left_semi").join(once.select("lookup", "id"), ["lookup", "id"], "left_anti")
    missing = missing.withColumn("p", F.row_number().over(Window.partitionBy("lookup", "id").orderBy("pos"))).where("p = 1").drop("p")
    missing = missing.withColumns({"language": F.lit(UNKNOWN), "pos": F.col("pos") + (1 << 30)})
    own = editions.join(works.where("ol_key is not null").select("lookup", F.col("ol_key").alias("key")), ["lookup", "key"], "left_semi").drop("key")
    seen = union(
        sighted(union(once, missing), "SBN", "work listing", "uniform title", stage=2), sighted(own, "Open Library", "work editions", "work key", stage=3),
    )
    out, notes = placed(seen, works)
    several = pages.groupBy("lookup", "id").agg(F.count_distinct("page").alias("pages")).where("pages > 1").groupBy("lookup").agg(F.count("*").alias("multi_language"))
    n = out.groupBy("lookup").agg(F.count_if(F.col("source") == "SBN").alias("sbn_rows"), F.count_if(F.col("source") == "Open Library").alias("open_library_rows"))
    recovered = missing.groupBy("lookup").agg(F.count_distinct("id").alias("recovered"))
    evidence = works.select("lookup").join(n, "lookup", "left").join(several, "lookup", "left").join(recovered, "lookup", "left").fillna(0)
    return out, notes, evidence


# S3 -----------------------------------------------------------------------------------------


def affinity(rows: DataFrame, titles: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``score``, the best similarity of a title to the lookup's titles (0 without one), to three places.

    Both sides' tokens are made once for each distinct title, and pairs meet on the lookup,
    whose titles are a handful.
    """
    mine = simjoin.with_tokens(rows.select(*key, "title").distinct(), "title")
    known = simjoin.with_tokens(titles.select("lookup", F.col("title").alias("known")), "known", "k_")
    pair = mine.join(known, "lookup")
    score = F.greatest(*[
        F.coalesce(text.title_similarity(F.col(t), F.col(f"k_{t}"), F.col(p), F.col(f"k_{p}")), F.lit(0.0)) for t, p in (("full", "plain"), ("core", "core_plain"))
    ])
    best = pair.groupBy(*key, "title").agg(F.max(score).alias("score"))
    names = [*key, "title"]
    best = best.select(*[F.col(k).alias(f"__{k}") for k in names], F.col("score").alias("__score"))
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names])
    return rows.join(best, on, "left").withColumn("score", F.round(F.coalesce("__score", F.lit(0.0)), 3)).drop("__score", *[f"__{k}" for k in names])


def store_isbns(held: DataFrame) -> DataFrame:
    """(lookup, isbn, place): the first distinct codes in hand, in arrival order."""
    raw = F.coalesce("isbns_raw", F.array().cast("array<string>")) if "isbns_raw" in held.columns else F.array().cast("array<string>")
    codes = F.concat(F.array("isbn"), raw)
    each = held.where("not refused").select("lookup", "seq", F.posexplode(codes).alias("at", "raw"))
    clean = each.withColumn("isbn", F.trim(F.replace("raw", F.lit("-"), F.lit("")))).where("isbn <> ''")
    first = clean.groupBy("lookup", "isbn").agg(F.min(F.struct("seq", "at")).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("lookup").orderBy("first"))).where(F.col("place") <= ISBN_PROBES).drop("first")


def recover(works: DataFrame, held: DataFrame, probes: DataFrame, sweeps: DataFrame, by_isbn: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sightings, notes, evidence): what other routes reached, gated on the work's titles; refused ones stay, marked.

    probes and sweeps: listing rows (lookup, pos, id, title, ...); by_isbn: (lookup, pos,
    isbn, id, ...).  Admitted sightings come before refused ones.
    """
    titled = works.where("identified").select("lookup")
    titles = work_titles(works).join(titled, "lookup", "left_semi")
    asked = by_isbn.join(store_isbns(held), ["lookup", "isbn"], "left_semi")
    each = union(*[f.withColumn("route", F.lit(r)) for f, r in ((probes, "title probe"), (sweeps, "author sweep"), (asked, "isbn probe"))])
    judged = affinity(each.join(titled, "lookup", "left_semi"), titles, ["lookup"])
    evidence = F.coalesce(gates.identifies(F.lit(False), F.col("route") == "isbn probe", F.col("score")), F.lit("refused"))
    rank = F.when(evidence == "refused", 1).otherwise(0)
    route = F.array_position(F.array(*[F.lit(r) for r in ROUTES]), F.col("route"))
    s = judged.withColumns({
        "evidence": evidence, "refused": evidence == "refused", "via": F.lit(None).cast("string"), "source": F.lit("SBN"), "seq": F.lit(4).cast("long") * (1 << 40) + rank * (1 << 38) + route * (1 << 32) + F.col("pos"),
    }).drop("pos")
    out, notes = placed(s, works)
    n = out.groupBy("lookup").agg(
        F.count_if(~F.col("refused")).alias("admitted"), F.count_if("refused").alias("refused"),
        F.count_if(F.col("refused") & (F.col("score") > 0)).alias("refused_above_zero"),
    )
    return out, notes, n


def reverse(works: DataFrame, questions: DataFrame, probes: DataFrame, sweeps: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sightings, evidence) for questions without any identity: the typed title gates, and the first seeds are read in full.

    A record of both routes counts on the first; full: (lookup, id, ...) of full records.
    """
    nameless = works.where("not identified").select("lookup")
    typed = questions.join(nameless, "lookup", "left_semi").select("lookup", F.col("typed_title").alias("title"))
    each = union(probes.withColumns({"route": F.lit("title probe"), "r": F.lit(0)}), sweeps.withColumns({"route": F.lit("author sweep"), "r": F.lit(1)})).join(nameless, "lookup", "left_semi")
    once = each.withColumn("p", F.row_number().over(Window.partitionBy("lookup", "id").orderBy("r", "pos"))).where("p = 1").drop("p")
    judged = affinity(once, typed, ["lookup"])
    seed = F.col("score") >= GATE
    nth = F.row_number().over(Window.partitionBy("lookup", seed).orderBy("r", "pos"))
    judged = judged.withColumns({"evidence": F.when(seed, "title match").otherwise("refused"), "nth": nth}).withColumn("read", seed & (F.col("nth") <= REVERSE_READ))
    extra = [c for c in full.columns if c not in ("lookup", "id")]
    wide = judged.join(full.select("lookup", "id", *[F.col(c).alias(f"full_{c}") for c in extra]), ["lookup", "id"], "left")
    for c in extra:
        wide = wide.withColumn(c, F.when(F.col("read"), F.coalesce(F.col(f"full_{c}"), F.col(c))).otherwise(F.col(c)) if c in judged.columns else F.when(F.col("read"), F.col(f"full_{c}")))
    rank = F.when(seed, 0).otherwise(1)
    out = wide.withColumns({"refused": ~seed, "via": F.lit(None).cast("string"), "source": F.lit("SBN"), "seq": F.lit(4).cast("long") * (1 << 40) + rank * (1 << 38) + F.col("r") * (1 << 36) + F.col("pos")})
    out = out.drop("pos", "r", "nth", "read", *[f"full_{c}" for c in extra])
    n = judged.groupBy("lookup").agg(F.count("*").alias("candidates"), F.count_if(seed).alias("seeds"), F.count_if("read").alias("read"))
    return out, n


# S4 -----------------------------------------------------------------------------------------


def first_in_order(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each lookup."""
    return rows.withColumn("p", F.row_number().over(Window.partitionBy("lookup").orderBy(*order))).where(F.col("p") <= cap).drop("p")


def enrich(works: DataFrame, records: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sightings, notes, evidence) of the full records of admitted national-catalogue rows, in order, up to a cap.

    full: (lookup, id, full_id, ...); a body of another id is empty.  A record whose body
    isn't there keeps its brief row and counts as failed.
    """
    held = records.where("source = 'SBN' and not refused and id is not null")
    todo = first_in_order(held.select("lookup", "id", "seq", "evidence", "score", F.col("isbn").alias("had_isbn"), F.col("language").alias("had_language")), ["seq"], ENRICH_CAP)
    got = todo.join(full, ["lookup", "id"], "left")
    read = got.where("full_id = id")
    s = read.withColumns({"pos": F.col("seq"), "source": F.lit("SBN")}).drop("full_id", "had_isbn", "had_language")
    s = s.withColumns({"seq": F.lit(5).cast("long") * (1 << 40) + F.row_number().over(Window.partitionBy("lookup").orderBy("pos")), "route": F.lit("full record"), "via": F.lit(None).cast("string"), "refused": F.lit(False)}).drop("pos")
    out, notes = placed(s, works)
    n = got.groupBy("lookup").agg(
        F.count("*").alias("asked"), F.count_if(F.col("full_id").isNull()).alias("failed"), F.count_if(F.col("full_id") != F.col("id")).alias("empty"),
        F.count_if((F.col("full_id") == F.col("id")) & F.col("had_isbn").isNull() & F.col("isbn").isNotNull()).alias("gained_isbn"),
        F.count_if((F.col("full_id") == F.col("id")) & (F.col("had_language") == UNKNOWN) & (F.coalesce("language", F.lit(UNKNOWN)) != UNKNOWN)).alias("gained_language"),
    )
    rows = held.groupBy("lookup").agg(F.count("*").alias("rows"))
    return out, notes, rows.join(n, "lookup", "left").withColumn("truncated", F.col("rows") > F.col("asked"))


def check_dates(records: DataFrame, index: DataFrame, failed: DataFrame, this_year: int) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence): the index values that records with a date that isn't plain are filed under.

    index: (lookup, language, value, id), the answers given; failed: (lookup, language) of
    which some answer is missing.  Only values that hold a year of the statement are asked.
    A record without an answer that the failure may explain is marked failed.
    """
    unsettled = records.where("not refused and date_indexed is null").where(dates.needs_check(F.col("source"), F.col("date"), this_year))
    todo = first_in_order(unsettled.select("lookup", "source", "id", "seq", "language", dates.candidates(F.col("date")).alias("years")), ["seq"], DATE_CAP)
    wanted = todo.select("lookup", "language", F.explode("years").alias("year")).distinct()
    values = index.select("lookup", "language", "value").distinct().withColumn("year", F.explode(dates.indexed_years(F.array("value"))))
    asked = values.join(wanted, ["lookup", "language", "year"], "left_semi").select("lookup", "language", "value").distinct()
    under = index.join(asked, ["lookup", "language", "value"], "left_semi").groupBy("lookup", "language", "id").agg(F.array_sort(F.collect_set("value")).alias("date_indexed"))
    got = todo.join(under, ["lookup", "language", "id"], "left").withColumn("date_indexed", F.coalesce("date_indexed", F.array().cast("array<string>")))
    got = got.join(failed.select("lookup", "language", F.lit(True).alias("lost")).distinct(), ["lookup", "language"], "left")
    matched = F.arrays_overlap(dates.indexed_years(F.col("date_indexed")), F.col("years"))
    answers = got.select("lookup", "source", "id", "date_indexed", (F.coalesce("lost", F.lit(False)) & ~F.coalesce(matched, F.lit(False))).alias("date_check_failed"))
    n = unsettled.groupBy("lookup").agg(F.count("*").alias("rows")).join(todo.groupBy("lookup").agg(F.count("*").alias("checked")), "lookup", "left")
    return answers, n.withColumn("truncated", F.col("rows") > F.col("checked"))


def reconcile(buckets: DataFrame, members: DataFrame, records: DataFrame, index: DataFrame, this_year: int) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence): plain years that a bucket's counts contradict.

    buckets: (lookup, bucket, value, results), the year facets of whole buckets; members:
    (lookup, bucket, id); index: (lookup, bucket, value, id).  Only values whose counts
    differ are asked, most different first, up to a cap a lookup; a record missing from
    its own year, asked or absent, is contradicted by the values it is under.
    """
    own = members.join(records.select("lookup", "id", dates.plain_year(F.col("date"), this_year).alias("year"), "date_indexed"), ["lookup", "id"])
    values = F.when(F.col("year").isNotNull(), F.array(F.col("year").cast("string"))).otherwise(F.coalesce("date_indexed", F.array().cast("array<string>")))
    expected = own.select("lookup", "bucket", F.explode(values).alias("value")).groupBy("lookup", "bucket", "value").agg(F.count("*").alias("expected"))
    both = buckets.join(expected, ["lookup", "bucket", "value"], "full").withColumn("listed", F.col("results").isNotNull())
    size = buckets.groupBy("lookup", "bucket").agg((F.count("*") >= YEAR_FACET).alias("capped"))
    both = both.join(size, ["lookup", "bucket"], "left").fillna(0, ["results", "expected"]).fillna(False, ["capped"])
    ask = both.where((F.col("listed") & (F.col("results") != F.col("expected"))) | (~F.col("listed") & F.col("capped")))
    order = [~F.col("listed"), F.desc(F.abs(F.col("results") - F.col("expected"))), "bucket", "value"]
    sent = first_in_order(ask, order, RECONCILE_CAP)
    absent = both.where(~F.col("listed") & ~F.col("capped")).select("lookup", "bucket", "value")
    doubted = sent.select("lookup", "bucket", "value").unionByName(absent).distinct()
    plain = own.where("year is not null").withColumn("value", F.col("year").cast("string")).join(doubted, ["lookup", "bucket", "value"], "left_semi").drop("value")
    filed = index.join(sent.select("lookup", "bucket", "value"), ["lookup", "bucket", "value"], "left_semi")
    under = plain.join(filed, ["lookup", "bucket", "id"], "left").groupBy("lookup", "bucket", "id", "year").agg(
        F.array_sort(F.array_compact(F.collect_set("value"))).alias("under"), F.bool_or(F.coalesce(dates.covers(F.col("value"), F.col("year")), F.lit(False))).alias("covered"),
    )
    answers = under.where("not covered").select("lookup", F.lit("SBN").alias("source"), "id", F.col("under").alias("date_indexed"), F.lit(False).alias("date_check_failed"))
    n = ask.groupBy("lookup").agg(F.count("*").alias("wanted")).join(sent.groupBy("lookup").agg(F.count("*").alias("asked")), "lookup", "left")
    return answers, n.withColumn("truncated", F.col("asked") < F.col("wanted"))


# Duplicates ---------------------------------------------------------------------------------


def duplicate_queries(works: DataFrame, questions: DataFrame) -> DataFrame:
    """(lookup, pos, title): a work's titles, then the typed one, each once whatever its case."""
    typed = questions.select("lookup", F.lit(1 << 20).alias("pos"), F.col("typed_title").alias("title"))
    each = work_titles(works).unionByName(typed).where("coalesce(title, '') <> ''")
    return each.withColumn("p", F.row_number().over(Window.partitionBy("lookup", F.lower("title")).orderBy("pos"))).where("p = 1").drop("p")


def find_duplicates(works: DataFrame, docs: DataFrame) -> DataFrame:
    """Other records of works whose main one is known, offered; docs as ``identity.offered_duplicates`` takes them."""
    main = works.where("ol_key is not null").select("lookup", F.col("ol_key").alias("key"))
    return identity.offered_duplicates(docs.join(main.select("lookup"), "lookup", "left_semi"), main)


def add_duplicates(works: DataFrame, offered: DataFrame, wanted: DataFrame, editions: DataFrame, failed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sightings, notes, unknown): editions of the records a reader chose; chosen keys that weren't offered are unknown.

    wanted, failed, added: (lookup, key); a record of which a page failed isn't added, and
    one added before isn't opened again.  editions: (lookup, key, pos, id, ...).
    """
    unknown = wanted.join(offered.select("lookup", "key"), ["lookup", "key"], "left_anti")
    chosen = wanted.join(offered.select("lookup", "key"), ["lookup", "key"], "left_semi").distinct()
    todo = chosen.join(failed, ["lookup", "key"], "left_anti").join(added, ["lookup", "key"], "left_anti")
    rows = editions.join(todo, ["lookup", "key"], "left_semi")
    out, notes = placed(sighted(rows, "Open Library", "duplicate work", "duplicate work", via=F.col("key"), stage=6).drop("key"), works)
    return out, notes, unknown


def held(sightings: DataFrame) -> DataFrame:
    """Records of all sightings: the first of each, gaps filled by later ones, the first admission replacing refusals."""
    kinds = dict(sightings.dtypes)
    fixed = {"lookup", "source", "id", "seq", "route", "evidence", "score", "via", "refused"}
    scalars = [c for c, k in kinds.items() if c not in fixed and not k.startswith("array")]
    lists = [c for c, k in kinds.items() if c not in fixed and k.startswith("array")]
    known = sightings.withColumn("language", F.nullif("language", F.lit(UNKNOWN)))
    out = store.upsert(known, ["lookup", "source", "id"], scalars=scalars, lists=lists, provenance=["route", "evidence", "score", "via"], refused="refused")
    return out.withColumn("language", F.coalesce("language", F.lit(UNKNOWN)))


def source_states(states: DataFrame, calls: DataFrame) -> DataFrame:
    """(lookup, source, state): over the stages the first that isn't ok, and partial where requests failed."""
    bad = F.col("state") != "ok"
    merged = states.groupBy("lookup", "source").agg(F.coalesce(F.min_by(F.when(bad, F.col("state")), F.when(bad, F.col("stage"))), F.lit("ok")).alias("state"))
    failed = calls.where("error is not null").groupBy("lookup", "source").agg(F.count("*").alias("failed"))
    out = merged.join(failed, ["lookup", "source"], "left")
    partial = F.concat(F.lit("partial ("), F.col("failed").cast("string"), F.lit(" failed)"))
    return out.select("lookup", "source", F.when((F.col("state") == "ok") & F.col("failed").isNotNull(), partial).otherwise(F.col("state")).alias("state"))


def causes(calls: DataFrame, slow_after: float = 10.0) -> DataFrame:
    """Per lookup and source the ledger's sums, most seconds first."""
    g = ledger.slow_causes(calls.withColumn("source", F.struct("lookup", "source")), slow_after)
    out = g.select(F.col("source.lookup").alias("lookup"), F.col("source.source").alias("source"), "requests", "seconds", "failed", "slow")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("lookup").orderBy(F.desc("seconds"), "source")))

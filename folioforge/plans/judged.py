"""Queries of the lookup's judgements, rows and notes, each with SQL that is independent of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import wording
from folioforge.operators import editions, identity, notes, rows, works
from folioforge.plans import records as R
from folioforge.plans import stages
from folioforge.plans.catalogue import query


def text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def none(kind: str) -> F.Column:
    return F.lit(None).cast(kind)


# Judgements ---------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_id // 6 AS lookup, event_id % 6 AS pos, event_type || event_id AS qid,
  CASE WHEN event_id % 5 = 0 THEN 'not a written work' WHEN event_id % 7 = 0 THEN 'an edition of a work, not the work' WHEN event_id % 3 = 0 THEN 'author disagrees'
    WHEN event_id % 10 < 6 THEN 'title 0.' || event_id % 10 || '0 < 0.6 (closest ' || event_type || ')' END AS reason FROM events),
f AS (SELECT lookup, min(pos) FILTER (reason IS NULL) AS stop, arg_min(qid, pos) FILTER (reason IS NULL) AS qid FROM c GROUP BY lookup)
SELECT f.lookup, f.qid, count(c.pos) FILTER (c.reason IS NOT NULL AND (f.stop IS NULL OR c.pos < f.stop)) AS refused, arg_min(c.reason, c.pos) FILTER (c.reason IS NOT NULL AND (f.stop IS NULL OR c.pos < f.stop)) AS first_reason
FROM f JOIN c USING (lookup) GROUP BY f.lookup, f.qid""")
def judged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of each six events that passes all four tests, and how many were refused before it."""
    i = F.col("event_id")
    c = R.table(spark, sf_dir, "events").select(
        F.floor(i / 6).alias("lookup"), (i % 6).alias("pos"), F.concat("event_type", text("event_id")).alias("qid"), (i % 5 != 0).alias("written"), (i % 7 == 0).alias("edition"),
        (i % 3 != 0).alias("author_agrees"), ((i % 10) / 10).alias("score"), F.col("event_type").alias("form"),
    )
    item, rejected = identity.judge_items(c)
    per = rejected.groupBy("lookup").agg(F.count("*").alias("refused"), F.min_by("reason", "pos").alias("first_reason"))
    every = c.select("lookup").distinct()
    return every.join(item.select("lookup", "qid"), "lookup", "left").join(per, "lookup", "left").fillna(0, ["refused"])


@query("""WITH g AS (SELECT o_custkey AS lookup, o_orderkey AS pos, o_orderpriority AS work, CASE WHEN o_orderkey % 3 = 0 THEN 'strong' WHEN o_orderkey % 3 = 1 THEN 'weak' ELSE 'no work' END AS tier, o_orderkey % 5 = 0 AS agrees FROM orders),
a AS (SELECT lookup, work, min(pos) AS pos, arg_min(tier, pos) AS tier FROM g WHERE tier = 'strong' OR (agrees AND tier = 'weak') GROUP BY ALL)
SELECT lookup, arg_min(work, pos) AS work, arg_min(tier, pos) AS tier, coalesce(array_to_string(list(work ORDER BY pos)[2:], ','), '') AS others FROM a GROUP BY lookup""")
def accepted_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first uniform title that a guard or the second signal accepts, and the further ones."""
    k = F.col("o_orderkey")
    g = R.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("lookup"), k.alias("pos"), F.col("o_orderpriority").alias("work"), F.when(k % 3 == 0, "strong").when(k % 3 == 1, "weak").otherwise("no work").alias("tier"), (k % 5 == 0).alias("agrees"),
    )
    return identity.accept_guards(g).select("lookup", "work", "tier", F.array_join("others", ",").alias("others"))


@query("""WITH d AS (SELECT c_nationkey AS lookup, c_custkey AS pos, c_name AS key, round((c_custkey % 11) / 10.0, 3) AS score, (c_custkey * 7 % 13)::INT AS n,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'author key' ELSE 'author name' END AS "by" FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY score DESC, n DESC, pos) AS p FROM d WHERE "by" IS NOT NULL AND score >= 0.6),
o AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY pos) AS q FROM f WHERE p > 1)
SELECT f.lookup, f.key, f.score::DOUBLE AS score, f.n AS edition_count, f."by", coalesce((SELECT string_agg(key, ',' ORDER BY pos) FROM o WHERE o.lookup = f.lookup AND q <= 4), '') AS others FROM f WHERE p = 1""")
def picked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-titled document of each nation, editions breaking ties, and four others."""
    k = F.col("c_custkey")
    d = R.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("lookup"), k.alias("pos"), F.col("c_name").alias("key"), F.col("c_name").alias("title"), ((k % 11) / 10).alias("score"), (k * 7 % 13).cast("int").alias("edition_count"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "author key").otherwise("author name").alias("by"),
    )
    return identity.pick_doc(d).select("lookup", "key", "score", "edition_count", "by", F.array_join("others", ",").alias("others"))


@query("""WITH r AS (SELECT event_id // 8 AS lookup, event_id % 2 AS form_pos, event_type AS id, event_id % 4 AS name, event_id % 16 = 0 AS equal, event_id % 3 = 0 AS contains, event_id AS pos FROM events),
e AS (SELECT *, 1 AS rule FROM r WHERE equal UNION ALL SELECT *, 2 FROM r WHERE contains),
m AS (SELECT lookup, min(form_pos * 10 + rule) AS k FROM e GROUP BY lookup),
h AS (SELECT e.* FROM e JOIN m ON e.lookup = m.lookup AND e.form_pos * 10 + e.rule = m.k)
SELECT lookup, rule, CASE WHEN count(DISTINCT name) = 1 THEN arg_min(id, pos) END AS id, count(DISTINCT name) > 1 AS ambiguous FROM h GROUP BY lookup, rule""")
def picked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person for each eight events: equal headings before containing ones, none where two names share the rule."""
    i = F.col("event_id")
    r = R.table(spark, sf_dir, "events").select(
        F.floor(i / 8).alias("lookup"), (i % 2).alias("form_pos"), text(i % 2).alias("form"), F.lit(2).alias("n_tokens"), F.col("event_type").alias("id"), i.alias("pos"), (i % 4).alias("name_key"),
        (i % 16 == 0).alias("equal"), (i % 3 == 0).alias("contains"), F.lit(False).alias("truncated"),
    )
    return identity.pick_person(r).select("lookup", "rule", "id", "ambiguous")


@query("""WITH a AS (SELECT event_id // 5 AS lookup, event_id % 3 AS form_pos, event_type AS id, event_id % 2 = 0 AS agrees FROM events),
f AS (SELECT lookup, id, bool_or(agrees) AS agrees, bool_or(agrees AND form_pos > 0) AS aliased FROM a GROUP BY ALL),
p AS (SELECT lookup, count(*) AS people, max(id) FILTER (id = 'view' AND lookup % 2 = 0) AS direct, count(*) FILTER (aliased) AS n, max(id) FILTER (aliased) AS other FROM f GROUP BY lookup)
SELECT lookup, coalesce(direct, CASE WHEN n = 1 THEN other END) AS resolved, coalesce(direct, CASE WHEN n = 1 THEN other END) IS NOT NULL AND people = 1 AS skip, people FROM p""")
def resolved_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a = R.table(spark, sf_dir, "events").select(
        F.floor(i / 5).alias("lookup"), (i % 3).alias("form_pos"), text(i % 3).alias("form"), F.col("event_type").alias("id"), F.col("event_type").alias("heading"), (i % 2 == 0).alias("agrees"),
    )
    picked = a.select("lookup").distinct().where("lookup % 2 = 0").select("lookup", F.lit("view").alias("id"))
    got = identity.resolve_people(a, picked)
    return got.groupBy("lookup").agg(F.first("resolved").alias("resolved"), F.first("skip").alias("skip"), F.count("*").alias("people"))


@query("""WITH r AS (SELECT DISTINCT p_size AS lookup, p_brand AS key, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS pos FROM part)
SELECT lookup, array_to_string(list(key ORDER BY pos)[1:6], ',') AS asked FROM (SELECT * FROM r WHERE key <> 'Brand#11') GROUP BY lookup""")
def asked_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six distinct spellings beside the title's own."""
    p = R.table(spark, sf_dir, "part").select(F.col("p_size").alias("lookup"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("spelling"), F.array("p_brand").alias("key"), F.array(F.lit("Brand#11")).alias("title_key"))
    got = identity.spellings(p)
    return got.groupBy("lookup").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "spelling"))), lambda x: x["spelling"]), ",").alias("asked"))


# An author's works --------------------------------------------------------------------------


@query("""SELECT o_custkey AS author, o_orderstatus AS value, arg_min(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY ALL""")
def facet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("label"))
    return works.works_union(o)


@query("""WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1800 + c_custkey % 200 END AS original, min(year(o_orderdate))::INT AS earliest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, coalesce(original, earliest)::INT AS year, CASE WHEN original IS NOT NULL THEN 'original' WHEN earliest IS NOT NULL THEN 'earliest' END AS kind FROM w""")
def work_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer").select("c_custkey")
    y = R.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))).alias("a"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.year("o_orderdate"))).alias("b"))
    original = F.when(F.col("c_custkey") % 4 == 0, (1800 + F.col("c_custkey") % 200).cast("int"))
    got = c.join(y, "c_custkey", "left").withColumn("w", works.row_year(original, works.earliest_year(F.col("a"), F.col("b"))))
    return got.select("c_custkey", "w.year", "w.kind")


@query("""WITH r AS (SELECT s_nationkey AS author, s_suppkey AS key, s_name AS title, CASE WHEN s_suppkey % 5 > 0 THEN 1900 + s_suppkey % 50 END AS year, CASE WHEN s_suppkey % 3 = 0 THEN 'contributed' ELSE 'works' END AS list FROM supplier)
SELECT author, key, list, year, row_number() OVER (PARTITION BY author, list ORDER BY year DESC NULLS LAST, lower(title), key)::INT AS place FROM r""")
def author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = R.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("author"), k.alias("key"), F.col("s_name").alias("title"), F.when(k % 5 > 0, k % 50 + 1900).alias("year"), (k % 3 != 0).alias("main_author"))
    return works.author_view(r).select("author", "key", "list", "year", "place")


@query("""WITH p AS (SELECT p_partkey, p_brand AS u, p_name AS t, CASE WHEN p_partkey % 3 = 0 THEN 'Жизнь' WHEN p_partkey % 3 = 1 THEN 'Original ' || p_partkey END AS o FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN o ELSE u END AS sent, CASE WHEN p_partkey % 3 = 1 THEN u || ',' || t ELSE t END AS variants FROM p""")
def lookup_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a work is looked up by, and its other Latin spellings."""
    k = F.col("p_partkey")
    o = F.when(k % 3 == 0, "Жизнь").when(k % 3 == 1, F.concat(F.lit("Original "), text("p_partkey")))
    uniform, forms = F.array(F.concat("p_brand", F.lit(" <film>. -"))), F.array(F.lit("東京"), F.col("p_name"))
    sent = works.lookup_title(o, uniform, forms, F.col("p_name"))
    return R.table(spark, sf_dir, "part").select("p_partkey", sent.alias("sent"), F.array_join(works.lookup_variants(uniform, forms, sent), ",").alias("variants"))


@query("""WITH n AS (SELECT o_custkey AS author, o_orderkey AS node, (o_orderkey * 13 % 90)::INT AS items, (o_totalprice / 1000)::INT AS total FROM orders)
SELECT author, sum(total)::BIGINT AS total, coalesce(sum(total) FILTER (items < 50), 0)::BIGINT AS covered, greatest(0, sum(total) - coalesce(sum(total) FILTER (items < 50), 0))::BIGINT AS uncovered FROM n GROUP BY author""")
def uncovered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a name that fell in no answer given whole: facets of 50 and more are cut."""
    n = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("node"), (F.col("o_orderkey") * 13 % 90).cast("int").alias("items"), F.rint(F.col("o_totalprice") / 1000).cast("int").alias("total"))  # halves to even, as its SQL
    whole, _ = works.leaves(n)
    return works.uncovered(n.groupBy("author").agg(F.sum("total").alias("total")), whole)


# Rows and notes -----------------------------------------------------------------------------


@query(f"""WITH {R.SQL}, n AS (SELECT lookup, CASE WHEN pages % 7 = 0 THEN publisher || ' & Co.' ELSE publisher END AS spelling, coalesce(isbn, source || ':' || id) AS e, lower(replace(publisher, '#', ' ')) AS k FROM rec),
s AS (SELECT lookup, array_to_string(list_sort(list_filter(string_split(k, ' '), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+'))), ' ') AS publisher_id, spelling, e FROM n),
c AS (SELECT lookup, publisher_id, spelling, count(*) AS m FROM s GROUP BY ALL)
SELECT s.lookup, s.publisher_id, count(DISTINCT s.e) AS editions, (SELECT first(spelling ORDER BY m DESC, length(spelling), spelling) FROM c WHERE c.lookup = s.lookup AND c.publisher_id = s.publisher_id) AS label FROM s GROUP BY s.lookup, s.publisher_id""")
def publisher_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers of each lookup's editions: one id for a house however it is spelled, named by its commonest spelling."""
    rec = R.records(spark, sf_dir).withColumn("edition_id", F.coalesce("isbn", F.concat_ws(":", "source", "id")))
    spelled = F.when(F.col("pages") % 7 == 0, F.concat("publisher", F.lit(" & Co."))).otherwise(F.col("publisher"))
    rec = rec.withColumns({"publisher": F.concat(spelled, F.lit(", Milano")), "publisher_names": none("array<string>"), "places": F.array(F.lit("Milano"))})
    return rows.publisher_list(rows.named_publishers(rec)).drop("place")


@query("""WITH r AS (SELECT o_custkey AS edition_id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate)::VARCHAR END AS year, CASE o_orderkey % 6 WHEN 0 THEN 'unsure' WHEN 1 THEN 'printed' WHEN 2 THEN 'no date' WHEN 3 THEN 'inferred' END AS note,
  CASE WHEN o_orderkey % 6 IN (0, 1) THEN year(o_orderdate)::VARCHAR END AS shown, 'c' || year(o_orderdate) AS date FROM orders),
g AS (SELECT edition_id, bool_or(year IS NOT NULL) AS dated, bool_or(note = 'unsure') AS u, bool_or(note = 'inferred') AS i, bool_or(note = 'printed') AS p, bool_or(note = 'no date') AS n,
  string_agg(DISTINCT shown, ' / ' ORDER BY shown) AS shown, string_agg(DISTINCT shown, ', ' ORDER BY shown) AS listed FROM r GROUP BY edition_id),
d AS (SELECT edition_id, string_agg(date, '; ' ORDER BY seq) AS dates FROM (SELECT edition_id, date, min(seq) AS seq FROM r WHERE note IS NOT NULL GROUP BY ALL) GROUP BY edition_id),
f AS (SELECT *, CASE WHEN u THEN 'unsure' WHEN i THEN 'inferred' WHEN p THEN 'printed' WHEN n AND NOT dated THEN 'no date' END AS note FROM g LEFT JOIN d USING (edition_id))
SELECT edition_id, note, CASE note WHEN 'unsure' THEN 'year unsure' WHEN 'inferred' THEN 'year inferred' WHEN 'printed' THEN 'printed ' || listed WHEN 'no date' THEN 'no year' END AS label,
  CASE WHEN note IS NOT NULL AND note <> 'printed' THEN shown END AS shown, CASE WHEN note = 'no date' THEN 'The catalogue gives no year.' WHEN note IS NOT NULL THEN 'Catalogue: ' || dates || '. ' || CASE note WHEN 'unsure' THEN 'Nothing to check it against.'
    WHEN 'inferred' THEN 'The year both agree on is shown.' ELSE 'SBN files it under the printing; the year shown is the publication''s.' END END AS detail FROM f""")
def year_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note, label, shown years and explanation of each edition's year."""
    k = F.col("o_orderkey")
    y = text(F.year("o_orderdate"))
    r = R.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("edition_id"), k.alias("seq"), F.when(k % 4 == 0, y).alias("year"), F.when(k % 6 == 0, "unsure").when(k % 6 == 1, "printed").when(k % 6 == 2, "no date").when(k % 6 == 3, "inferred").alias("year_note"),
        F.when((k % 6).isin(0, 1), F.array(y)).otherwise(F.array().cast("array<string>")).alias("years_shown"), F.concat(F.lit("c"), y).alias("date"), none("array<string>").alias("date_indexed"),
    )
    n = rows.year_notes(r).withColumn("x", rows.note_of(F.col("year_note"), none("string"), F.col("shown_years"), F.col("statements"), F.col("indexed"), F.col("asked")))
    return n.select("edition_id", F.col("year_note").alias("note"), "x.label", "x.shown", "x.detail")


@query("""WITH r AS (SELECT c_nationkey AS lookup, c_custkey::VARCHAR AS id, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'swept' ELSE 'matched' END AS grp, c_custkey % 7 / 10.0 AS score, CASE WHEN c_custkey % 5 > 0 THEN (1900 + c_custkey % 90)::VARCHAR END AS year FROM customer WHERE c_custkey % 2 = 0)
SELECT lookup, id, grp AS "group", year, row_number() OVER (PARTITION BY lookup, grp ORDER BY score DESC, year DESC NULLS LAST, id)::INT AS place FROM r""")
def refused_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = R.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("lookup"), text("c_custkey").alias("id"), F.lit("SBN").alias("source"), F.col("c_name").alias("title"), F.when(k % 5 > 0, text(k % 90 + 1900)).alias("year"), none("array<string>").alias("years_shown"),
        none("string").alias("publisher"), none("string").alias("url"), F.when(k % 3 == 0, "author sweep").otherwise("title probe").alias("route"), ((k % 7) / 10).alias("score"), (k % 2 == 0).alias("refused"),
    )
    return rows.band_rows(r).select("lookup", "id", "group", "year", "place")


@query(f"""WITH {R.SQL}, e AS (SELECT lookup, coalesce(isbn, id) AS edition_id, min(year) AS y, arg_min(title, id) AS title FROM rec GROUP BY ALL),
f AS (SELECT lookup, arg_min(title, (y, edition_id)) AS t FROM e GROUP BY lookup)
SELECT lookup, CASE WHEN lookup % 5 = 0 THEN 'Original ' || lookup WHEN lookup % 5 = 1 THEN 'Titolo ' || lookup ELSE t END AS title FROM f""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each lookup's work: the original's, the one in its language, or the earliest edition's."""
    rec = R.records(spark, sf_dir).withColumn("edition_id", F.coalesce("isbn", "id"))
    e = rec.groupBy("lookup", "edition_id").agg(text(F.min("year")).alias("year"), F.min_by("title", "id").alias("title"))
    k, titled = F.col("lookup"), F.create_map(F.lit("ita"), F.concat(F.lit("Titolo "), text("lookup")))
    w = rec.select("lookup").distinct().select("lookup", F.when(k % 5 == 0, F.concat(F.lit("Original "), text("lookup"))).alias("original_title"), F.when(k % 5 == 1, "ita").alias("original_language"), titled.alias("titles"))
    return rows.display_titles(e, w)


@query("""WITH r AS (SELECT o_custkey AS lookup, o_orderkey, o_orderkey % 6 AS k FROM orders WHERE o_orderkey % 4 > 0)
SELECT lookup, CASE k WHEN 0 THEN 'linked to this work in SBN' WHEN 1 THEN 'found by other routes — SBN holds them but has not linked them' WHEN 2 THEN 'found by other routes — SBN holds them but has not linked them'
  WHEN 3 THEN 'in Open Library''s record for this work' WHEN 4 THEN 'in Open Library''s other records for the same work' ELSE 'admitted on other evidence' END AS line, count(*) AS n FROM r GROUP BY ALL""")
def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("uniform title", "title match", "isbn", "work key", "duplicate work", "hearsay")])
    r = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lookup"), kinds[(k % 6).cast("int")].alias("evidence"), (k % 4 == 0).alias("refused"))
    return rows.ledger(r)


@query("""WITH c AS (SELECT c_custkey, c_custkey * 37 AS total, c_custkey * 37 - c_custkey % 3 AS rows, c_custkey % 5 AS k, c_name AS t FROM customer)
SELECT c_custkey, concat_ws(' | ', CASE WHEN k = 1 THEN 'SBN offered 50 uniform titles for this question and stops there, so the work was chosen from the first 50' END,
  CASE WHEN c_custkey % 3 > 0 THEN 'the SBN listing read ' || format('{:,}', rows) || ' of ' || format('{:,}', total) || ' records filed under this work' END,
  CASE WHEN k = 2 THEN 'the title probe for ''' || t || ''' read ' || format('{:,}', rows) || ' of ' || format('{:,}', total) || ' records' END,
  CASE WHEN k = 3 THEN 'full records were read for 1,500 of ' || format('{:,}', total) || ' SBN rows; the rest are listed as the listing has them, so their printings are not grouped' END,
  CASE WHEN k = 4 THEN 'the 2 searches for Open Library''s other records read the first 100 results each, and each found more (up to ' || format('{:,}', total + 200) || ')' END) AS lines FROM c""")
def truncation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each cap that a lookup hit, in the order of the stages."""
    n = F.col("c_custkey")
    k, total, read = n % 5, n * 37, n * 37 - n % 3
    made = {
        "identity": F.struct((k == 1).alias("facet_truncated"), none("array<string>").alias("spellings"), none("int").alias("offered")),
        "listing": F.struct(read.alias("rows"), total.alias("total"), F.lit(False).alias("truncated"), F.lit(False).alias("facet_truncated")),
        "recovery": F.struct(
            F.struct(none("long").alias("rows"), none("long").alias("total"), F.lit(False).alias("truncated")).alias("sweep"), none("array<struct<authority:string,rows:long,total:long,truncated:boolean>>").alias("others"),
            F.array(F.struct(F.col("c_name").alias("title"), read.alias("rows"), total.alias("total"), (k == 2).alias("truncated"))).alias("probes"),
        ),
        "enrich": F.struct(F.lit(1500).alias("asked"), total.alias("rows"), (k == 3).alias("truncated")),
        "dates": F.struct(none("long").alias("checked"), none("long").alias("rows"), F.lit(False).alias("truncated"), none("long").alias("asked_years"), none("long").alias("wanted_years"), F.lit(False).alias("years_truncated")),
        "duplicates": F.struct(F.when(k == 4, F.array(*[F.struct(F.col("c_name").alias("title"), F.lit(100).alias("docs"), (total + add).alias("total")) for add in (150, 200)])).alias("queries")),
    }
    c = R.table(spark, sf_dir, "customer").select("c_custkey", *[x.alias(name) for name, x in made.items()])
    return c.select("c_custkey", F.array_join(notes.truncations(), " | ").alias("lines"))


@query("""SELECT o_orderkey, CASE WHEN s > 20 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Slow lookup (' || s || ' s), though no request in it went to the network.' ELSE 'Slow lookup (' || s || ' s). Measured in it: ' || o_orderstatus || '; ' || o_orderpriority
  || '. Request times are summed across requests that ran in parallel, so they can add up to more than the lookup took.' END END AS slow,
  CASE WHEN f > 0 THEN 'Incomplete: ' || f || CASE WHEN f = 1 THEN ' request' ELSE ' requests' END || ' failed, so editions are probably missing — a whole language can drop out this way. Everything that did arrive is cached, so running the same search again is fast and usually fills the gaps.' END AS incomplete
FROM (SELECT *, o_orderkey % 30 AS s, o_orderkey % 3 AS f FROM orders)""")
def network_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    causes = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", wording.slow(k % 30, causes, 20.0).alias("slow"), wording.incomplete(k % 3).alias("incomplete"))


# Stages -------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey AS lookup, l_partkey AS id, l_linenumber AS page FROM lineitem), p AS (SELECT lookup, id, count(DISTINCT page) AS pages FROM l GROUP BY ALL),
w AS (SELECT o_orderkey AS lookup FROM orders WHERE o_orderkey % 3 > 0), x AS (SELECT l_orderkey AS lookup, l_suppkey AS id FROM lineitem WHERE l_linenumber = 1),
m AS (SELECT DISTINCT x.lookup, x.id FROM x JOIN w USING (lookup) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.lookup = x.lookup AND p.id = x.id))
SELECT o_orderkey AS lookup, CASE WHEN w.lookup IS NULL THEN 0 ELSE (SELECT count(*) FROM p WHERE p.lookup = o_orderkey) + (SELECT count(*) FROM m WHERE m.lookup = o_orderkey) END AS sbn_rows,
  CASE WHEN w.lookup IS NULL THEN 0 ELSE (SELECT count(*) FROM p WHERE p.lookup = o_orderkey AND pages > 1) END AS multi_language, (SELECT count(*) FROM m WHERE m.lookup = o_orderkey) AS recovered FROM orders LEFT JOIN w ON w.lookup = o_orderkey""")
def listed_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's listing: a record of several pages counts once, and the unfiltered pass adds what the pages missed."""
    k = F.col("o_orderkey")
    w = R.table(spark, sf_dir, "orders").select(k.alias("lookup"), F.when(k % 3 > 0, "w").alias("sbn_work"), none("array<string>").alias("sbn_others"), none("string").alias("ol_key"), none("string").alias("original_language"))
    line = R.table(spark, sf_dir, "lineitem")
    made = {"title": F.lit("t"), "translators": none("array<string>"), "translation_evidence": none("array<string>"), "statement": none("string")}
    pages = line.select(F.col("l_orderkey").alias("lookup"), F.lit("w").alias("work"), F.col("l_linenumber").alias("page"), F.col("l_linenumber").cast("long").alias("pos"), text("l_partkey").alias("id"), F.lit("ita").alias("language")).withColumns(made)
    whole = line.where("l_linenumber = 1").select(F.col("l_orderkey").alias("lookup"), F.lit(0).cast("long").alias("pos"), text("l_suppkey").alias("id")).withColumns(made)
    other = pages.limit(0).withColumn("key", F.lit("k")).drop("work", "page")
    return stages.list_editions(w, pages, whole, other)[2].drop("open_library_rows")


@query("""WITH b AS (SELECT o_custkey AS lookup, year(o_orderdate)::VARCHAR AS value, count(*) AS expected FROM orders GROUP BY ALL), f AS (SELECT *, expected + CASE WHEN (lookup + value::INT) % 3 = 0 THEN 1 ELSE 0 END AS results FROM b),
a AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY abs(results - expected) DESC, value) AS p FROM f WHERE results <> expected)
SELECT lookup, count(*) AS wanted, count(*) FILTER (p <= 60) AS asked, count(*) > 60 AS truncated FROM a GROUP BY lookup""")
def reconciled_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of which a bucket's count differs from its records', and how many are asked."""
    o = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lookup"), text("o_orderkey").alias("id"), text(F.year("o_orderdate")).alias("date"), F.lit("b").alias("bucket"), none("array<string>").alias("date_indexed"))
    off = F.when((F.col("lookup") + F.col("value").cast("int")) % 3 == 0, 1).otherwise(0)
    facet = o.groupBy("lookup", "bucket", F.col("date").alias("value")).agg(F.count("*").alias("n")).select("lookup", "bucket", "value", (F.col("n") + off).alias("results"))
    index = o.select("lookup", "bucket", F.col("date").alias("value"), "id")
    return stages.reconcile(facet, o.select("lookup", "bucket", "id"), o, index, 2026)[1]


@query("""WITH s AS (SELECT c_nationkey AS lookup, c_mktsegment AS source, c_custkey % 7 AS stage, CASE WHEN c_custkey % 11 = 0 THEN 'error: down' ELSE 'ok' END AS state FROM customer),
m AS (SELECT lookup, source, coalesce(min((stage, state)) FILTER (state <> 'ok'), NULL) AS w FROM s GROUP BY ALL), f AS (SELECT c_nationkey AS lookup, c_mktsegment AS source, count(*) AS n FROM customer WHERE c_custkey % 13 = 0 GROUP BY ALL)
SELECT m.lookup, m.source, CASE WHEN w IS NOT NULL THEN 'error: down' WHEN f.n IS NOT NULL THEN 'partial (' || f.n || ' failed)' ELSE 'ok' END AS state FROM m LEFT JOIN f ON m.lookup = f.lookup AND m.source = f.source""")
def lookup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = R.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("lookup"), F.col("c_mktsegment").alias("source"), (k % 7).alias("stage"), F.when(k % 11 == 0, "error: down").otherwise("ok").alias("state"), F.when(k % 13 == 0, "timeout").alias("error"))
    return stages.source_states(s, s)


@query(f"""WITH {R.SQL}, y AS (SELECT isbn AS edition_id, list_sort(list(DISTINCT year)) AS ys, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS routes, bool_and(source = 'SBN') AS added, arg_min(language, id) AS language FROM rec WHERE isbn IS NOT NULL GROUP BY isbn)
SELECT edition_id AS id, ys[1]::INT AS year_num, array_to_string(ys, ',') AS years_num, sources, routes::INT AS routes, added, language AS language_name FROM y""")
def edition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the edition list: years as numbers, sources, routes, and whether a reader added the row."""
    rec = R.records(spark, sf_dir).where("isbn is not null").withColumns({"edition_id": F.col("isbn"), "seq": F.col("id"), "lookup": F.lit(1)})
    rec = rec.withColumns({"authors": F.array().cast("array<string>"), "translators": F.array().cast("array<string>"), "evidence": F.array().cast("array<string>"), "series": none("string"), "url": none("string"), "physical": none("string")})
    fields = editions.edition_fields(rec.drop("isbn")).withColumns({"lookup": F.lit(1), "isbn": F.col("edition_id")})
    settled = rec.select("edition_id", "seq", text("year").alias("year"), none("string").alias("year_note"), F.array().cast("array<string>").alias("years_shown"), none("string").alias("date"), none("array<string>").alias("date_indexed"))
    routes = rows.provenance(rec.select("edition_id", "seq", F.lit(0).alias("route_seq"), "source", F.lit("work listing").alias("route"), F.when(F.col("source") == "SBN", "duplicate work").otherwise("work key").alias("evidence"), none("double").alias("score"), "id", none("string").alias("via")))
    ids = rows.publisher_ids(rows.named_publishers(rec.withColumns({"publisher_names": none("array<string>"), "places": none("array<string>")})))
    groups, multi = fields.select("edition_id", F.lit("").alias("work_group")), rows.also_in(rec.select("edition_id", "language"), fields)
    e = rows.edition_rows(fields, rows.year_notes(settled), ids, routes, groups, multi, F.array().cast("array<array<string>>"))
    return e.select("id", "year_num", F.array_join(F.col("years_num").cast("array<string>"), ",").alias("years_num"), F.array_join("sources", ",").alias("sources"), F.size("provenance").alias("routes"), "added", "language_name")

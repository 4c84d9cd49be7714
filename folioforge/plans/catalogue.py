"""The driver's queries, each through an operator, and SQL that is independent of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import dates, isbn, langs, publishers, text, wording
from folioforge.operators import authors, editions, evidence, filters, gates, ledger, setjoin, simjoin, store, view
from folioforge.operators.components import by_shared_key, containment_groups, containment_pairs
from folioforge.plans import records as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def long(c) -> F.Column:
    return c.cast("long")


# Editions and views -----------------------------------------------------------------------


@query(f"""WITH {R.SQL} SELECT language, count(DISTINCT isbn) + count(*) FILTER (isbn IS NULL) AS editions,
  min(year) AS first_year, max(year) AS last_year FROM rec GROUP BY language""")
def editions_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions (by ISBN; a record without one is its own) and year span of each language."""
    rec = R.records(spark, sf_dir)
    per = rec.groupBy("language").agg(
        (F.count_distinct("isbn") + F.count_if(F.col("isbn").isNull())).alias("editions"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    return per


@query(f"""WITH {R.SQL}, per AS (SELECT language, count(*) AS editions, min(year) AS first_year, max(year) AS last_year FROM
  (SELECT language, coalesce(isbn, id) AS e, min(year) AS year FROM rec GROUP BY ALL) GROUP BY language)
SELECT language, editions, first_year, last_year, (language = 'NATION_6' AND 1995 BETWEEN first_year AND last_year) AS is_original,
  row_number() OVER (ORDER BY first_year, editions DESC, language)::INT AS place FROM per""")
def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = R.records(spark, sf_dir).withColumn("e", F.coalesce("isbn", "id"))
    return view.spans(rec.groupBy("language", "e").agg(F.min("year").alias("year")), "NATION_6", 1995)


@query("""WITH c AS (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS f, lpad(p_partkey::VARCHAR, 9, '0') AS t FROM part)
SELECT p_partkey, f || ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(f, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10)::VARCHAR AS isbn13,
  CASE (11 - list_sum(list_transform(range(1, 10), lambda i: substr(t, i, 1)::INT * (11 - i))) % 11) % 11 WHEN 10 THEN t || 'X'
    ELSE t || ((11 - list_sum(list_transform(range(1, 10), lambda i: substr(t, i, 1)::INT * (11 - i))) % 11) % 11)::VARCHAR END AS isbn10,
  true AS valid FROM c""")
def isbn13_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    part = R.table(spark, sf_dir, "part").withColumn("isbn10", F.concat(t, isbn.check10(t)))
    out = part.select("p_partkey", isbn.to_isbn13(F.col("isbn10")).alias("isbn13"), "isbn10")
    return out.withColumn("valid", isbn.valid(F.col("isbn10")) & isbn.valid(F.col("isbn13")))


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS n, p_partkey AS c FROM part UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 7 <> 0),
e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (c)),
r(n, m) AS (SELECT n, n FROM k UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a)
SELECT r.n AS p_partkey, min(k.c) AS edition FROM r JOIN k ON r.m = k.n GROUP BY r.n""")
def fold_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of records that share a code: each part has its key, and the next unless it divides by 7."""
    key = F.col("p_partkey")
    codes = F.array_compact(F.array(key, F.when(key % 7 != 0, key + 1)))
    rows = R.table(spark, sf_dir, "part").select(key.alias("n"), F.explode(codes).alias("code"))
    return by_shared_key(rows, "n", "code").select(F.col("node").alias("p_partkey"), F.col("label").alias("edition"))


@query(f"""WITH {R.SQL} SELECT coalesce(isbn, source || ':' || id) AS edition_id, count(*) AS records, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  min(year)::VARCHAR AS year, max(year)::VARCHAR AS latest, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS printings,
  arg_min(language, id) AS language, arg_min(publisher, id) AS publisher FROM rec GROUP BY 1""")
def edition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = R.records(spark, sf_dir).withColumn("edition_id", F.coalesce("isbn", F.concat_ws(":", "source", "id"))).withColumn("seq", F.col("id"))
    out = editions.edition_fields(rec.drop("isbn", "medium"))
    return out.select("edition_id", "records", F.array_join("sources", ",").alias("sources"), "year", "latest", F.array_join("printings", ",").alias("printings"), "language", "publisher")


EVENTS = "SELECT *, nullif(value, round(value)) AS v, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || event_id % 5 END AS note, event_type = 'error' OR event_id % 4 = 0 AS refused FROM events"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat("event_type", (F.col("event_id") % 5).cast("string")))
    refused = (F.col("event_type") == "error") | (F.col("event_id") % 4 == 0)
    e = R.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))
    return e.withColumns({"note": note, "refused": refused, "seq": F.col("event_id"), "route": F.concat(F.lit("r"), (F.col("event_id") % 6).cast("string"))})


@query("""SELECT user_id, event_type, min(event_id) AS seq, count(*) AS routes, arg_min(note, event_id) FILTER (note <> '') AS note,
  coalesce(arg_min(event_id % 6, event_id) FILTER (NOT refused), arg_min(event_id % 6, event_id)) AS route, bool_and(refused) AS refused
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || event_id % 5 END AS note, event_type = 'error' OR event_id % 4 = 0 AS refused FROM events) GROUP BY ALL""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).withColumn("route", F.col("event_id") % 6)
    return store.upsert(s, ["user_id", "event_type"], scalars=["note"], provenance=["route"], refused="refused")


@query("""WITH s AS (SELECT *, 'r' || event_id % 6 AS route, event_type = 'error' OR event_id % 4 = 0 AS refused FROM events),
r AS (SELECT user_id, event_type, bool_and(refused) AS refused FROM s GROUP BY ALL)
SELECT 'source' AS dimension, event_type AS value, count(*) AS n FROM r GROUP BY event_type
UNION ALL SELECT 'route', route, count(*) FROM s GROUP BY route
UNION ALL SELECT 'state', CASE WHEN refused THEN 'refused' ELSE 'admitted' END, count(*) FROM r GROUP BY 2""")
def store_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    held = store.upsert(s, ["user_id", "event_type"], refused="refused")
    return store.coverage(s, held, {"source": "event_type", "route": "route"}, "refused")


@query("""SELECT o_orderkey, o_custkey, y, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC NULLS LAST, o_orderkey)::INT AS place
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS y FROM orders)""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.year("o_orderdate"))
    return editions.newest_first(R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", y.alias("y")), "o_custkey", "y", "o_orderkey")


@query("""SELECT n_name, o_orderkey, o_totalprice, place FROM (SELECT n_name, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey)::INT AS place
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 10""")
def top_k_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = R.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    place = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.select("n_name", "o_orderkey", "o_totalprice").withColumn("place", place).where("place <= 10")


@query(f"""WITH {R.SQL}, w AS (SELECT *, 1992 + work % 4 AS original_year, 'NATION_7' AS original FROM rec),
f AS (SELECT work, min(year) FILTER (year >= original_year) AS year, count(*) FILTER (year < original_year) AS older_dropped FROM w GROUP BY work)
SELECT f.work, f.year, f.older_dropped, string_agg(DISTINCT language, ',' ORDER BY language) AS languages,
  arg_min(id, (CASE WHEN language = 'NATION_7' THEN '0' ELSE '1' END) || id) AS lead_seq
FROM f LEFT JOIN w ON w.work = f.work AND w.year = f.year AND w.year >= original_year GROUP BY ALL""")
def earliest_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = R.records(spark, sf_dir).withColumns({"original_year": long(F.lit(1992) + F.col("work") % 4), "original": F.lit("NATION_7"), "seq": F.col("id")})
    return view.earliest(rec, "work", "original_year", "original")


@query("""WITH n AS (SELECT lower(replace(p_brand, '#', '')) AS publisher, CASE WHEN l_linenumber % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS label, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT publisher, sum(n)::BIGINT AS editions, first(label ORDER BY n DESC, length(label), label) AS label FROM n GROUP BY publisher""")
def publisher_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = R.table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber"), R.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    label = F.when(F.col("l_linenumber") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    rows = line.join(part, line.l_partkey == part.p_partkey).select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("publisher"), label.alias("label"))
    return view.facets(rows, "publisher", "label")


@query("""WITH b AS (SELECT DISTINCT n, list_distinct(string_split(lower(n), ' ')) AS t FROM
  (SELECT p_name AS n FROM part UNION SELECT p_name || ' ' || p_type FROM part WHERE p_partkey % 5 = 0 UNION SELECT p_type || ' ' || split_part(p_name, ' ', 2) FROM part))
SELECT x.n AS a, y.n AS b FROM b x, b y WHERE x.n < y.n AND (list_has_all(x.t, y.t) OR list_has_all(y.t, x.t))""")
def publisher_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of which one's words contain the other's; only names that share a word are compared."""
    part = R.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    names = part.select(F.col("p_name").alias("n")).union(part.where("p_partkey % 5 = 0").select(F.concat_ws(" ", "p_name", "p_type")))
    names = names.union(part.select(F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))))).distinct()
    pairs = containment_pairs(names.withColumn("t", F.array_distinct(F.split(F.lower("n"), " "))), "n", "t")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query(f"""WITH {R.SQL}, e AS (SELECT coalesce(isbn, source || ':' || id) AS edition_id, arg_min(id, id) AS pos, arg_min(language, id) AS language, min(year) AS year,
  list(DISTINCT source) AS sources, min(isbn) AS isbn, arg_min(publisher, id) AS publisher, list_sort(list(DISTINCT pages)) AS pages FROM rec GROUP BY 1)
SELECT a.edition_id AS a, b.edition_id AS b, a.language, a.year FROM e a JOIN e b ON a.language = b.language AND a.year = b.year AND a.pos < b.pos
WHERE NOT list_has_any(a.sources, b.sources) AND (a.isbn IS NULL OR b.isbn IS NULL) AND a.publisher = b.publisher
AND len(list_filter(a.pages, lambda x: len(list_filter(b.pages, lambda y: abs(x - y) <= greatest(10.0, 0.1 * greatest(x, y)))) > 0)) > 0""")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints that two editions of a language and year, of different sources, may be one."""
    rec = R.records(spark, sf_dir).withColumn("edition_id", F.coalesce("isbn", F.concat_ws(":", "source", "id")))
    e = rec.groupBy("edition_id").agg(
        F.min("id").alias("pos"), F.min_by("language", "id").alias("language"), F.min("year").alias("year"), F.collect_set("source").alias("sources"),
        F.min("isbn").alias("isbn"), F.array(F.array(F.min_by("publisher", "id"))).alias("publisher_keys"), F.collect_set("pages").alias("pages"),
    )
    return editions.collisions(e)


@query("""SELECT l_orderkey, bool_and(abs(a - b) > greatest(10.0, 0.1 * greatest(a, b))) AS disagree FROM
(SELECT x.l_orderkey, x.q AS a, y.q AS b FROM (SELECT l_orderkey, (l_quantity * 7)::INT AS q FROM lineitem WHERE l_linenumber % 2 = 1) x
 JOIN (SELECT l_orderkey, (l_quantity * 7)::INT AS q FROM lineitem WHERE l_linenumber % 2 = 0) y USING (l_orderkey)) GROUP BY l_orderkey""")
def page_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = R.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("side"), F.concat((F.col("l_quantity") * 7).cast("int").cast("string"), F.lit(" p.")).alias("physical"))
    count = publishers.page_count(F.col("physical"))
    g = line.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("side") == 1, count)).alias("a"), F.collect_set(F.when(F.col("side") == 0, count)).alias("b"))
    return g.where((F.size("a") > 0) & (F.size("b") > 0)).select("l_orderkey", publishers.pages_disagree(F.col("a"), F.col("b")).alias("disagree"))


# Text and similarity ----------------------------------------------------------------------

#: The stop words as the SQL knows them.
_STOP = "', '".join(
    "the a an of and or in on to for is at by with from as its that this into about be are was were it his her their how la le lo il gli un una uno di del dei degli "
    "della delle dello al alla alle ai agli allo dal dalla dalle dai dagli nel nella nelle nei negli sul sulla sulle sui sugli con per tra fra che non ed come "
    "les des du de en sur essai el los las y".split()
)


def _sql_tokens(column: str) -> str:
    ascii_ = f"regexp_replace(strip_accents({column}), '[^\\x00-\\x7F]', '', 'g')"
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({ascii_}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('{_STOP}'))))"


@query(f"SELECT doc_id, array_to_string({_sql_tokens('text')}, ' ') AS tokens FROM documents")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meaningful tokens of each document."""
    return R.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.normalize("text"), " ").alias("tokens"))


@query("""WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS t FROM part)
SELECT a.p_name AS l, b.p_name AS r, len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS score FROM n a, n b
WHERE len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) >= 0.5""")
def title_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.table(spark, sf_dir, "part").select("p_name").distinct().withColumn("t", F.array_distinct(F.split("p_name", " ")))
    return simjoin.token_join(names, names, "p_name", "p_name", "t", 0.5)


_PAIRS = """WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS t FROM part),
p AS (SELECT a.p_name AS l, b.p_name AS r, len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS score FROM n a, n b
  WHERE a.p_name <> b.p_name AND len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) >= 0.5)"""


_WORDS = "list_distinct(string_split(lower(text), ' '))"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), w AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d),
p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) / greatest(a.n, b.n) AS score FROM w a JOIN w b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
k AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY score DESC) AS place FROM p WHERE score >= 0.6)
SELECT l, min(r) AS r, min(score) AS score FROM k WHERE place = 1 GROUP BY l HAVING count(*) = 1""")
def best_match_no_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one best other document of each document by their words."""
    d = R.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    return setjoin.best_match(d, "doc_id", "t", 0.6)


@query(_PAIRS + ", k AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY score DESC) AS place FROM p) SELECT l, r, score FROM k WHERE place = 1")
def tied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.tied(title_similarity_join(spark, sf_dir).where("l <> r"))


@query(_PAIRS + " SELECT l, max({'s': score, 'f': r}).s AS score, max({'s': score, 'f': r}).f AS form FROM p GROUP BY l")
def title_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.title_test(title_similarity_join(spark, sf_dir).where("l <> r").withColumnRenamed("r", "form"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), b AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
s AS (SELECT doc_id, max(len(list_intersect(d.t, b.t)) / greatest(len(d.t), len(b.t))) AS affinity FROM d, b GROUP BY doc_id)
SELECT doc_id, CASE WHEN affinity >= 0.6 THEN round(affinity, 6) END AS affinity, CASE WHEN doc_id % 11 = 0 THEN 'uniform title' WHEN doc_id % 13 = 0 THEN 'isbn' WHEN affinity >= 0.6 THEN 'title match' END AS reason FROM s""")
def title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each document is admitted against the known texts of ``benchmark``; affinities under 0.6 are null."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    docs = R.table(spark, sf_dir, "documents").select("doc_id", words.alias("t"))
    known = R.table(spark, sf_dir, "benchmark").select("item_id", words.alias("t"))
    score = setjoin.set_join(docs, known, "doc_id", "item_id", "t", 0.6).groupBy(F.col("l").alias("doc_id")).agg(F.max("score").alias("affinity"))
    out = docs.select("doc_id").join(score, "doc_id", "left")
    reason = gates.identifies(F.col("doc_id") % 11 == 0, F.col("doc_id") % 13 == 0, F.col("affinity"))
    return out.select("doc_id", F.round("affinity", 6).alias("affinity"), reason.alias("reason"))


@query("""WITH q AS (SELECT DISTINCT user_id, event_id % 50 AS id FROM events WHERE event_type = 'view' OR event_type = 'click'), w AS (SELECT DISTINCT user_id, event_id % 50 AS id FROM events WHERE event_id % 2 = 0),
u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT u.user_id, count(q.id) AS matched, count(w.id) AS filed FROM u LEFT JOIN q USING (user_id) LEFT JOIN w ON q.user_id = w.user_id AND q.id = w.id GROUP BY u.user_id)
SELECT user_id, matched, filed, CASE WHEN matched > 0 THEN filed / matched END AS share,
  CASE WHEN matched = 0 THEN 'no work' WHEN filed / matched > 0.5 THEN 'strong' WHEN filed / matched = 0.5 THEN 'weak' ELSE 'rejected' END AS tier FROM s""")
def share_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 50).alias("id"))
    out = gates.share_b(e, e.where("event_id % 2 = 0"), "user_id", "id", F.col("event_type").isin("view", "click"))
    return out.withColumn("tier", gates.tier(F.when(F.col("matched") > 0, F.lit(0.0)), F.col("share")))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM c)
SELECT user_id, min(event_type) FILTER (k = 1) AS event_type, max(n) AS n, count(*) FILTER (k = 1) AS tied FROM r GROUP BY user_id""")
def pick_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return gates.pick_first(counts, "user_id", "n", "event_type")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT p_name AS n, list_sort(list_distinct(string_split(p_name, ' ')))[1:2] AS t FROM part),
k AS (SELECT DISTINCT array_to_string(t, ' ') AS k, t FROM s),
e AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON list_has_all(a.t, b.t) OR list_has_all(b.t, a.t)),
r(k, m) AS (SELECT k, k FROM k UNION SELECT r.k, e.b FROM r JOIN e ON r.m = e.a),
g AS (SELECT r.k, string_agg(DISTINCT w, ' ' ORDER BY w) AS grp FROM r, unnest(string_split(r.m, ' ')) AS u(w) GROUP BY r.k)
SELECT s.n AS node, g.grp AS "group" FROM s JOIN g ON array_to_string(s.t, ' ') = g.k""")
def same_person_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.table(spark, sf_dir, "part").select("p_name").distinct()
    return containment_groups(names.withColumn("t", F.slice(F.array_sort(F.array_distinct(F.split("p_name", " "))), 1, 2)), "p_name", "t")


@query("""WITH b AS (SELECT event_id // 6 AS ask, user_id AS book, count(DISTINCT event_type) AS sources, count(*) AS editions FROM events GROUP BY ALL),
w AS (SELECT *, count(*) OVER p AS books, count(*) FILTER (sources >= 2) OVER p AS several, count(*) FILTER (sources < 2 AND editions > 1) OVER p AS odd FROM b WINDOW p AS (PARTITION BY ask))
SELECT ask, book, sources, editions FROM w WHERE books = 1 OR (several = 1 AND odd = 0 AND sources >= 2)""")
def adopted_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    books = e.groupBy(F.floor(F.col("event_id") / 6).alias("ask"), F.col("user_id").alias("book")).agg(F.count_distinct("event_type").alias("sources"), F.count("*").alias("editions"))
    return gates.adopted_book(books, "ask", "sources", "editions")


@query("""SELECT c_nationkey, count(*) AS unlinked FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey""")
def semi_anti_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    left = authors.unlinked(c, o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 300000"), "c_custkey", F.col("c_nationkey").cast("string"))
    return left.select(F.col("title").cast("int").alias("c_nationkey"), F.col("records").alias("unlinked"))


# Filters, dates, languages ----------------------------------------------------------------


@query("""WITH r AS (SELECT CASE WHEN n_name = 'NATION_3' THEN 'no-language' WHEN n_name NOT IN ('NATION_1', 'NATION_2', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7') THEN 'other-language'
  WHEN o_orderkey % 6 = 0 THEN 'no-year' WHEN NOT year(o_orderdate) BETWEEN 1994 AND 1996 THEN 'outside-years' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'other-publisher' END AS reason
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT coalesce(reason, 'shown') AS reason, count(*) AS n FROM r GROUP BY 1""")
def year_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_name") == "NATION_3", "unknown").otherwise(F.col("n_name")).alias("language"))
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    years = F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<int>")).otherwise(F.array(F.year("o_orderdate")))
    reason = filters.why(F.col("language"), years, F.array("o_orderpriority"), [f"NATION_{i}" for i in (1, 2, 4, 5, 6, 7)], 1994, 1996, ["1-URGENT", "2-HIGH"])
    shown, hidden = filters.apply(rows, reason)
    return hidden.withColumnRenamed("hidden", "n").unionByName(shown.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("shown").alias("reason"), "n"))


@query(f"WITH {R.SQL} SELECT language, publisher, count(*) AS n FROM rec WHERE year BETWEEN 1994 AND 1995 AND contains(lower(publisher), 'brand#1') GROUP BY ALL")
def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(R.records(spark, sf_dir), F.col("year"), 1994, 1995, "BRAND#1").groupBy("language", "publisher").agg(F.count("*").alias("n"))


@query(r"""SELECT event_id, nullif(regexp_extract(s, '\b(1[0-9]{3}|20[0-9]{2})\b', 1), '')::INT AS year FROM
(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'c' || (1500 + event_id % 600) WHEN 1 THEN 'Roma, ' || (1500 + event_id % 600) || '.' WHEN 2 THEN 'n. ' || event_id WHEN 3 THEN '[' || (1900 + event_id % 200) || ']' ELSE 's.d.' END AS s FROM events)""")
def year_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = (
        F.when(i % 5 == 0, F.concat(F.lit("c"), (i % 600 + 1500).cast("string"))).when(i % 5 == 1, F.concat(F.lit("Roma, "), (i % 600 + 1500).cast("string"), F.lit(".")))
        .when(i % 5 == 2, F.concat(F.lit("n. "), i.cast("string"))).when(i % 5 == 3, F.concat(F.lit("["), (i % 200 + 1900).cast("string"), F.lit("]"))).otherwise("s.d.")
    )
    return R.table(spark, sf_dir, "events").select("event_id", dates.year_of(s).alias("year"))


@query("""WITH s AS (SELECT event_id, 1900 + event_id % 90 AS y, event_id % 12 AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 2, 3, 8, 9) THEN y::VARCHAR WHEN k = 5 THEN (y + 3)::VARCHAR END AS year,
  CASE k WHEN 1 THEN 'no date' WHEN 4 THEN 'unsure' WHEN 5 THEN 'inferred' WHEN 6 THEN 'unchecked' WHEN 7 THEN 'unsure' WHEN 8 THEN 'printed' WHEN 10 THEN 'other calendar' WHEN 11 THEN 'unsure' END AS note,
  CASE k WHEN 4 THEN (y - 2) || ',' || y WHEN 6 THEN y || ',' || (y + 3) WHEN 7 THEN 'anno III' WHEN 8 THEN (y + 1)::VARCHAR WHEN 10 THEN '1333' WHEN 11 THEN y || ',' || (y + 5) || ',' || (y + 9) ELSE '' END AS shown FROM s""")
def settle_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case of the decision table for each remainder of the event id."""
    i = F.col("event_id")
    y = i % 90 + 1900
    t = lambda c: c.cast("string")
    none, nil, both = F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.concat(t(y), F.lit(" "), t(y + 3))
    cases = [  # year, statement, index, failed
        (t(y), nil, none, False), (nil, nil, none, False), (nil, t(y), none, False), (nil, t(y), F.array(t(y)), False), (nil, t(y), F.array(t(y - 2)), False),
        (nil, both, F.array(t(y + 3)), False), (nil, both, F.array().cast("array<string>"), True), (nil, F.lit("anno III"), none, False),
        (nil, F.concat(t(y), F.lit(", stampa "), t(y + 1)), F.array(t(y + 1)), False), (nil, both, F.array(t(y)), False), (nil, F.lit("1333 h."), none, False),
        (nil, F.concat(t(y + 9), F.lit(" "), t(y)), F.array(F.concat_ws("-", t(y + 5), t(y + 5))), False),
    ]
    pick = lambda k: F.element_at(F.array(*[c[k] if k < 3 else F.lit(c[k]) for c in cases]), (i % 12 + 1).cast("int"))
    rows = R.table(spark, sf_dir, "events").select("event_id", pick(0).alias("y"), pick(1).alias("s"), pick(2).alias("i"), pick(3).alias("f"))
    return dates.settle_rows(rows, "y", "s", "i", "f", 2026).select("event_id", "settled.year", "settled.note", F.array_join("settled.shown", ",").alias("shown"))


@query("""WITH o AS (SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT year(l_shipdate)::INT AS y, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o.y, l.y) AS year, coalesce(o.n, 0) AS facet_n, coalesce(l.n, 0) AS record_n FROM o FULL JOIN l ON o.y = l.y WHERE coalesce(o.n, 0) <> coalesce(l.n, 0)""")
def values_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    line = R.table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count_distinct("l_orderkey").alias("n"))
    return ledger.values_to_ask(o, line, "year")


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS k, year(l_shipdate)::INT AS y FROM lineitem), o AS (SELECT o_orderkey AS k, year(o_orderdate)::INT AS y FROM orders)
SELECT o.k AS id, o.y AS year, string_agg(f.y::VARCHAR, ',' ORDER BY f.y::VARCHAR) AS filed FROM o JOIN f ON o.k = f.k GROUP BY ALL HAVING NOT bool_or(f.y = o.y)""")
def contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    filed = R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.year("l_shipdate").alias("year")).distinct()
    return ledger.contradicted(o, filed, "id", "year")


@query("""SELECT lang, code, count(*) AS n, CASE code WHEN 'eng' THEN 'inglese' WHEN 'fre' THEN 'francese' WHEN 'ger' THEN 'tedesco' WHEN 'spa' THEN 'spagnolo' WHEN 'ita' THEN 'italiano' ELSE 'lingua non indicata' END AS name FROM
(SELECT lang, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' WHEN 'es' THEN 'spa' WHEN 'it' THEN 'ita' ELSE 'unknown' END END AS code FROM documents) GROUP BY ALL""")
def language_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = langs.from_two_letter(F.when(F.col("doc_id") % 9 == 0, F.lit("und")).otherwise(F.concat("lang", F.lit("-x"))))
    d = R.table(spark, sf_dir, "documents").select("lang", code.alias("code"))
    return d.groupBy("lang", "code").agg(F.count("*").alias("n")).withColumn("name", langs.display(F.col("code")))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Жизнь и судьба ' || source ELSE text END AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^\\p{Cyrillic}\\p{Greek}]', '', 'g')) > length(regexp_replace(t, '[^\\p{Latin}]', '', 'g')) AS contradicts,
  NOT regexp_matches(t, '\\p{Cyrillic}') AS latin FROM d""")
def script_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Жизнь и судьба "), "source")).otherwise(F.col("text"))
    return R.table(spark, sf_dir, "documents").select("doc_id", text.script_contradicts(t).alias("contradicts"), text.is_latin(t).alias("latin"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) WHEN c_custkey % 3 = 1 THEN split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) ELSE c_name END AS display,
  CASE WHEN c_custkey % 3 = 0 THEN split_part(c_name, '#', 2) WHEN c_custkey % 3 = 1 THEN split_part(c_name, '#', 2) ELSE c_name END AS surname FROM customer""")
def author_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split_part("c_name", F.lit("#"), F.lit(1)), F.split_part("c_name", F.lit("#"), F.lit(2))
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.concat(b, F.lit(", "), a, F.lit(" <1900-1980>"))).when(k == 1, F.concat(a, F.lit(" "), b)).otherwise(F.col("c_name"))
    rows = R.table(spark, sf_dir, "customer").select("c_custkey", name.alias("n"))
    return rows.select("c_custkey", text.author_display(F.col("n")).alias("display"), text.surname(F.col("n")).alias("surname"))


@query("""WITH d AS (SELECT sha256(lower(trim(text))) AS title, doc_id FROM documents)
SELECT title, count(*) AS records FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY title""")
def unlinked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("t"))
    linked = R.table(spark, sf_dir, "labels").select("doc_id")
    return authors.unlinked(d, linked, linked, "doc_id", F.col("t"))


# Ledger, versions, parsing ----------------------------------------------------------------


@query("""SELECT CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'opened' ELSE 'other' END AS line, sum(n)::BIGINT AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1""")
def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return view.ledger_lines(counts, {"view": "seen", "click": "opened"})


@query("""WITH c AS (SELECT event_type AS source, (event_id % 40)::DOUBLE AS seconds, CASE WHEN event_id % 17 = 0 THEN 'timeout' END AS error, CASE WHEN event_id % 3 = 0 THEN (event_id % 12)::DOUBLE END AS waited FROM events),
g AS (SELECT source, count(*) AS requests, sum(seconds) AS seconds, count(error) AS failed, count(*) FILTER (seconds - coalesce(waited, 0) > 10) AS slow FROM c GROUP BY source)
SELECT *, CASE WHEN failed > 0 THEN 'partial (' || failed || ' failed)' ELSE 'ok' END AS state FROM g""")
def ledger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    calls = R.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), (i % 40).cast("double").alias("seconds"), F.when(i % 17 == 0, "timeout").alias("error"), F.when(i % 3 == 0, (i % 12).cast("double")).alias("waited"),
    )
    causes = ledger.slow_causes(calls)
    states = ledger.source_states(causes.select("source", F.lit("ok").alias("state")), causes)
    return causes.join(states, "source")


@query("""SELECT first(p_name ORDER BY p_partkey) AS title, min(p_partkey) AS p_partkey, count(*) AS spellings FROM part GROUP BY list_sort(string_split(p_name, ' '))""")
def dedupe_first_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.array_sort(F.split("p_name", " ")).alias("key"))
    n = rows.groupBy("key").agg(F.count("*").alias("spellings"))
    return authors.first_spelling(rows, "key", "p_partkey").join(n, "key").select("title", "p_partkey", "spellings")


@query("""SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return R.table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("""WITH s AS (SELECT *, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS batch FROM events), v AS (SELECT unnest(range(4)) AS version)
SELECT version, event_type, count(*) AS sightings, count(DISTINCT user_id) AS records FROM v JOIN s ON s.batch <= v.version GROUP BY ALL""")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view after each of four batches of sightings: a row of a batch counts in its version and all later ones."""
    e = R.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    top = e.agg((F.max("event_id") + 1).alias("top"))
    batch = e.join(F.broadcast(top)).withColumn("batch", F.floor(F.col("event_id") * 4 / F.col("top")))
    first = batch.groupBy("event_type", "user_id").agg(F.min("batch").alias("batch")).groupBy("event_type", "batch").agg(F.count("*").alias("records"))
    seen = batch.groupBy("event_type", "batch").agg(F.count("*").alias("sightings")).join(first, ["event_type", "batch"], "full")
    per = seen.withColumn("version", F.explode(F.sequence(F.col("batch"), F.lit(3).cast("long"))))
    return per.groupBy("version", "event_type").agg(F.coalesce(F.sum("sightings"), F.lit(0)).alias("sightings"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


@query(f"""WITH {R.SQL}, g AS (SELECT lookup, language, count(*) AS editions, min(year) AS first_year, max(year) AS last_year FROM rec GROUP BY ALL),
n AS (SELECT lookup, language, publisher AS title, count(*) AS n FROM rec GROUP BY ALL), b AS (SELECT lookup FROM g GROUP BY lookup HAVING count(*) > 1)
SELECT g.*, (SELECT first(title ORDER BY n DESC, title) FROM n WHERE n.lookup = g.lookup AND n.language = g.language) AS title FROM g JOIN b USING (lookup)""")
def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of each lookup that has several."""
    return view.choices(R.records(spark, sf_dir).drop("title").withColumnRenamed("publisher", "title"), "lookup", "language", "title", "year")


@query("""WITH r AS (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'unsure' WHEN 1 THEN 'printed' WHEN 2 THEN 'inferred' WHEN 3 THEN 'no date' END AS note FROM orders)
SELECT o_custkey, CASE WHEN bool_or(note = 'unsure') THEN 'unsure' WHEN bool_or(note = 'inferred') THEN 'inferred' WHEN bool_or(note = 'printed') THEN 'printed' WHEN bool_or(note = 'no date') THEN 'no date' END AS note FROM r GROUP BY o_custkey""")
def row_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    note = F.when(k == 0, "unsure").when(k == 1, "printed").when(k == 2, "inferred").when(k == 3, "no date")
    return view.row_note(R.table(spark, sf_dir, "orders").select("o_custkey", note.alias("note")), "o_custkey", "note", dates.SEVERITY)


@query(f"WITH {R.SQL} SELECT isbn, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM rec WHERE isbn IS NOT NULL GROUP BY isbn HAVING count(DISTINCT language) > 1")
def also_filed_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = R.records(spark, sf_dir).where("isbn is not null")
    return view.also_filed_as(rec, "isbn", "language").select("isbn", F.array_join("languages", ",").alias("languages"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) % 3 <> 0), b AS (SELECT min(y) AS lo, max(y) AS hi FROM y)
SELECT u.y::INT AS year FROM b, unnest(range(1980, 2006)) AS u(y) WHERE u.y NOT IN (SELECT y FROM y)""")
def extra_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return authors.extra_years(R.table(spark, sf_dir, "orders").where(y % 3 != 0).select(y.alias("year")).distinct(), 1980, 2005).select("year")


@query("""SELECT c_nationkey, first(c_custkey ORDER BY c_acctbal DESC, c_custkey) AS lead FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) GROUP BY c_nationkey""")
def duplicate_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey", "c_acctbal", "c_name")
    left = gates.duplicate_works(c, R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), "key", "c_acctbal", "c_name", "c_name")
    return left.groupBy("c_nationkey").agg(F.min_by("key", F.struct(-F.col("c_acctbal"), "key")).alias("lead"))


@query("""SELECT source, CASE WHEN min(stage_no) FILTER (state <> 'ok') IS NULL THEN 'ok' ELSE arg_min(state, stage_no) FILTER (state <> 'ok') END AS state FROM
(SELECT 'n' || c_nationkey AS source, c_custkey AS stage_no, CASE WHEN c_custkey % 29 = 0 THEN 'down' WHEN c_custkey % 31 = 0 THEN 'slow' ELSE 'ok' END AS state FROM customer) GROUP BY source""")
def merge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    state = F.when(k % 29 == 0, "down").when(k % 31 == 0, "slow").otherwise("ok")
    return store.merge_states(R.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"), k.alias("stage_no"), state.alias("state")))


@query("""SELECT e AS store, 'https://example.org/' || e || '?q=' || isbn AS url, isbn FROM (SELECT '978' || lpad(p_partkey::VARCHAR, 9, '0') || '0' AS isbn FROM part WHERE p_partkey % 2 = 0), unnest(['one', 'two']) AS u(e)""")
def store_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("0")))
    shops = [(n, f"https://example.org/{n}?q=") for n in ("one", "two")]
    rows = R.table(spark, sf_dir, "part").select(code.alias("isbn"))
    return rows.select("isbn", F.inline(isbn.links(F.col("isbn"), shops)))


# People, labels and wording ---------------------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT event_id // 4 AS ask, event_id % 3 AS form, event_type AS id, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 1 WHEN event_id % 4 = 0 AND event_id % 6 <> 0 THEN 2 ELSE 3 END AS rule FROM events),
n AS (SELECT *, count(*) OVER (PARTITION BY ask, form) AS people, count(*) OVER (PARTITION BY ask, form, rule) AS k FROM r)
SELECT ask, first(id ORDER BY form, rule) AS id, first(form ORDER BY form, rule) AS form, first(rule ORDER BY form, rule)::INT AS rule FROM n WHERE k = 1 AND (rule < 3 OR people = 1) GROUP BY ask""")
def pick_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = R.table(spark, sf_dir, "events").withColumns({"ask": F.floor(i / 4), "form": i % 3, "id": F.col("event_type")})
    return evidence.pick_authority(rows, "ask", "form", (F.col("event_type") == "view") & (i % 5 == 0), i % 4 == 0, i % 6 == 0)


@query("""WITH p AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name DESC)::INT AS place FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT * FROM p WHERE place <= 3""")
def closest_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("score"), F.col("c_name").alias("title"))
    return evidence.closest(c, "c_nationkey").drop("score", "title")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS items, count(DISTINCT l_partkey) >= 50 AS capped FROM lineitem GROUP BY l_suppkey")
def facet_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.capped(R.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey")


@query("""SELECT o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus || '|' || year(o_orderdate) ELSE o_orderkey::VARCHAR END AS entry,
  min(o_orderstatus) AS medium, min(year(o_orderdate))::INT AS year, count(*) AS records FROM orders GROUP BY 1, 2""")
def derived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("medium"), F.year("o_orderdate").alias("year"),
        (F.col("o_orderstatus") != "F").alias("stated"), F.lit(1).alias("records"),
    )
    return evidence.derived(o, "o_custkey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1900 + p_partkey % 100 END AS y, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS l, CASE WHEN p_partkey % 5 <> 0 THEN 1990 END AS f FROM part)
SELECT p_partkey, CASE WHEN y IS NOT NULL AND l IS NOT NULL THEN 'first published in ' || l || ', ' || y WHEN y IS NOT NULL THEN 'first published ' || y
  WHEN l IS NOT NULL THEN 'originally in ' || l WHEN f IS NOT NULL THEN 'earliest edition found: ' || f END AS phrase FROM p""")
def origin_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    y, lang, seen = F.when(k % 2 == 0, k % 100 + 1900), F.when(k % 3 == 0, F.col("p_brand")), F.when(k % 5 != 0, F.lit(1990))
    return R.table(spark, sf_dir, "part").select("p_partkey", evidence.origin_phrase(y, lang, seen).alias("phrase"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN 'unknown' WHEN doc_id % 3 = 0 THEN 'srp' ELSE 'ita' END AS language FROM documents""")
def place_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    title = F.when(i % 4 == 0, "Жизнь и судьба").otherwise("Vita e destino")
    rows = R.table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.when(i % 3 == 0, "srp").otherwise("ita").alias("language"))
    return evidence.place_language(rows, "title", "language")[0].select("doc_id", "language")


@query("""WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders), l AS (SELECT o_custkey, list_sort(list(p)) AS ps FROM s GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN len(ps) > 1 THEN array_to_string(ps[1:len(ps) - 1], ', ') || ' and ' || ps[len(ps)] ELSE ps[1] END AS names FROM l""")
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("ps"))
    return o.select("o_custkey", wording.listed(F.col("ps")).alias("names"))



from folioforge.plans import judged  # noqa: E402, F401 registers its queries

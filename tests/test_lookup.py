"""Parsers, notes, stages and jobs of lookups."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from folioforge.operators import evidence, identity, notes, rows, works
from folioforge.plans import stages
from folioforge.sources import parse, report
from folioforge.streaming.jobs import AuthorJob, Job, Registry, Stage


def bodies(spark, *items):
    return spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "lookup int, body string")


def test_full_records(spark):
    rec = {
        "codiceIdentificativo": "IT\\ICCU\\CFI\\0123456", "titolo": "Opera / di A ; traduzione di B", "pubblicazione": "Roma : Laterza ; Bari : Dedalo, 1999", "nomi": ["[Autore]  Rossi, A", "[Traduttore]  Bianchi"],
        "numeri": ["[ISBN]  8842000000", "[BNI]  1"], "isbn": "9788842000000", "note": ["Trad. di B", "x"],
        "localizzazioni": [{"isil": "IT-1", "shelfmarks": [{"shelfmark": "Biblioteca", "invNum": "Roma"}, {}]}, {"isil": "IT-2", "denominazione": "Altra"}],
    }
    r = parse.brief_records(bodies(spark, rec, {})).orderBy("lookup").collect()
    assert (r[0]["isbns_raw"], r[0]["publisher_names"], r[0]["authors"], r[0]["translators"]) == (["8842000000", "9788842000000"], ["Laterza", "Dedalo"], ["Rossi, A"], ["Bianchi"])
    assert r[0]["translation_evidence"] == ["Trad. di B", "di A ; traduzione di B", "Traduttore: Bianchi"]
    assert [tuple(h) for h in r[0]["holdings"]] == [("Biblioteca", "Roma", "IT-1"), ("", "", "IT-1"), ("Altra", "", "IT-2")]
    assert r[1]["title"] == "" and r[1]["language"] == "unknown" and r[1]["holdings"] == []


def test_open_catalogue(spark):
    book = {"key": "/books/OL1M", "covers": [-1, 7], "ocaid": " a ", "description": {"type": "t", "value": "long"}, "notes": "bare", "translated_from": [{"key": "/languages/fre"}], "number_of_pages": 9}
    b = parse.book_details(bodies(spark, book)).first()
    assert (b["cover_url"][-9:], b["archive_url"][-2:], b["description"], b["notes"], b["translated_from"], b["pages"], b["url"][-5:]) == ("b/id/7-M.jpg"[-9:], "/a", "long", "bare", ["fre"], 9, "/OL1M")
    d = parse.work_docs(bodies(spark, {"key": "/works/OL2W", "language": ["ita", "eng", "ita", "und"], "author_key": ["OL1A", "/authors/OL2A"], "first_publish_year": 1980, "edition_count": 3})).first()
    assert (d["id"], d["languages"], d["author_keys"], d["year"], d["edition_count"]) == ("OL2W", ["eng", "ita"], ["/authors/OL1A", "/authors/OL2A"], "1980", 3)


def test_listing_and_authorities(spark):
    row = lambda i, **x: {"id": i, "title": {"info": "T / translated from the Japanese", "text": "A, B"}, "infos": x.get("infos", [])}
    data = {"data": {"total": 250, "results": [row("ITICCUUBO0000001", infos=["Fa parte di: X", "533 p", "Milano: Y, 1980", "Testo - Monografia [IT\\ICCU\\X]"]), row("bad id")], "facets": [{"name": "l", "items": [{"label": "a", "results": 2, "value": "v"}]}]}}
    r = parse.listing_records(bodies(spark, data), "it").collect()
    assert [(x["id"], x["publisher"], x["places"], x["medium"], x["language"], x["translation_evidence"], x["lookup"]) for x in r] == [("UBO0000001", "Y, Milano", ["Milano"], "testo", "ita", ["translated from the Japanese"], 0)]
    assert tuple(parse.totals(bodies(spark, data)).first())[1:] == (250, 12, True)
    a = parse.authority_rows(bodies(spark, {"data": {"results": [{"id": "CFIV000001", "title": {"text": "Eco, U"}, "infos": ["Persona"]}]}})).first()
    assert (a["id"], a["heading"], a["kind"]) == ("CFIV000001", "Eco, U", "Persona")
    table = {"data": {"results": [{"contents": [{"body": [
        [{"type": "table-title", "value": "Titolo di opera"}, {"contents": [{"values": [{"href": "x?Titolo_uniforme:@frase@=AB1", "value": "opera"}, {"href": "no"}]}]}],
        [{"type": "table-title", "value": "Lingua"}, {"value": " ITALIANO "}], [{"type": "table-title", "value": "Forme varianti"}, {"contents": [{"value": "uno"}, {"value": ""}]}],
    ]}]}]}}
    links = bodies(spark, table, {"data": None}).select("lookup", parse.work_links("body").alias("l")).orderBy("lookup").collect()
    assert [tuple(x) for x in links[0]["l"]] == [("AB1", "opera")] and links[1]["l"] == []
    w = parse.work_authorities(bodies(spark, table, {"data": None})).orderBy("lookup").collect()
    assert [(x["language"], x["variants"]) for x in w] == [("ITALIANO", ["uno"]), (None, [])]


def test_items(spark):
    claim = lambda v, **k: {"mainsnak": {"datavalue": {"value": v}}} | k
    item = {
        "labels": {"it": {"value": "Rosa"}, "en": {"value": "Rose"}}, "sitelinks": {"itwiki": {"title": "Rosa (romanzo)"}, "frwiki": {"title": "Rose (roman)"}, "commonswiki": {"title": "Category:Rosa"}},
        "claims": {
            "P31": [claim({"id": "Q8261"})], "P50": [claim({"id": "Q1"})], "P361": [claim({"id": "Q9"})], "P1476": [claim({"text": "Il nome", "language": "it"})],
            "P577": [claim({"time": "+1986-00-00T00:00:00Z", "precision": 9}, rank="normal"), claim({"time": "+1980-01-01T00:00:00Z", "precision": 9}, rank="normal"), claim({"time": "+1900-00-00T00:00:00Z", "precision": 9}, rank="deprecated")],
        },
    }
    table = spark.createDataFrame([("Q5", json.dumps(item)), ("Q6", "{}")], "qid string, body string")
    e = parse.entities(table, names_only=True).orderBy("qid").collect()
    assert (e[0]["names"], e[0]["original_title"], e[0]["original_language"], e[0]["original_year"], e[0]["titles"], e[0]["part_of"]) == (["Rose", "Rosa", "Il nome"], "Il nome", "ita", 1980, {"ita": "Rosa", "eng": "Rose", "fre": "Rose"}, ["Q9"])
    assert parse.entities(table).where("qid = 'Q5'").first()["names"] == ["Rose", "Rosa", "Category:Rosa", "Il nome"]
    assert e[1]["names"] == [] and e[1]["original_year"] is None and e[1]["original_language"] == "unknown"
    ok = parse.entities(table).select("qid", identity.is_written_work(F.col("kinds"), F.col("authors"), F.col("date_year").isNotNull()), identity.is_edition(F.col("kinds"))).orderBy("qid").collect()
    assert [tuple(x)[1:] for x in ok] == [(True, False), (False, False)]


def test_spelling_and_author_notes(spark):
    ident = "struct<facet_truncated:boolean,title_item:boolean,spellings:array<string>,offered:int,filed_under:array<string>,author_forms:int,author_why_not:string,author_ids:array<string>,authority:string,title_asked:boolean,author_asked:boolean>"
    rec = "struct<why_not:string,sweep:struct<rows:long,total:long,truncated:boolean,why_not:string>,others:array<struct<authority:string,rows:long,total:long,truncated:boolean>>,probes:array<struct<title:string,rows:long,total:long,truncated:boolean,why_not:string>>>"
    data = [
        ((False, True, ["a", "b's"], 2, ["W"], 2, None, ["X", "Y"], "X", True, True), (None, None, [("Y", 1, 1, False)], [("t", 0, 0, False, "no")]), (["l"],), ("d", None)),
        ((False, False, [], 0, [], 0, None, [], None, True, True), ("r", None, [], []), (None,), (None, None)),
        ((False, True, [], 0, [], 1, None, ["Y"], "X", True, True), (None, None, [], []), (None,), (None, None)),
    ]
    t = spark.createDataFrame(data, f"identity {ident}, recovery {rec}, listing struct<why_not:array<string>>, duplicates struct<why_not:string,queries:array<struct<title:string,docs:long,total:long>>>")
    got = t.select(notes.spellings(), notes.not_asked()).collect()
    assert got[0][0] == ["other spellings of the title asked of SBN: 'a', \"b's\"; SBN files them under 'W'", "other spellings of the author: 2 asked of SBN, which files the same person under 1 more name record, swept: Y (1 record)"]
    assert got[0][1] == ["l", "'t': no", "d"] and got[1][1] == ["r"]
    assert got[1][0][1] == "other spellings of the author: none asked — Wikidata did not answer" and "not swept" in got[2][0][1]
    a = spark.createDataFrame([([("Eco", True, True, 1200, 1000, ["ita", "eng"])], (5, 9), (3, 3), [(2, 5, True)], (1, 4, True), 1)], notes.AUTHOR_EVIDENCE)
    lines = a.select(notes.author_truncations()).first()[0]
    assert len(lines) == 7 and "at least 200 of 1,200 records" in lines[1] and lines[2].startswith("2 of those questions") and lines[3] == "read 5 of 9 Wikidata works naming this person" and lines[6].startswith("1 work has")


SIGHT = "lookup int, pos long, id string, title string, language string, translators array<string>, translation_evidence array<string>, statement string, isbn string"


def sight(*rows_):
    return [(1, i, x[0], x[1], x[2] if len(x) > 2 else "ita", [], [], None, x[3] if len(x) > 3 else None) for i, x in enumerate(rows_)]


WORK = "lookup int, sbn_work string, sbn_others array<string>, ol_key string, ol_title string, original_title string, original_language string, titles map<string,string>, identified boolean"


def test_stages(spark):
    w = spark.createDataFrame([(1, "nome della rosa", [], "OL1W", "The name of the rose", "Il nome della rosa", "ita", {"eng": "The Name of the Rose"}, True)], WORK)
    assert [r["title"] for r in stages.work_titles(w).orderBy("pos").collect()] == ["Il nome della rosa", "The Name of the Rose", "nome della rosa"]
    page = spark.createDataFrame(sight(("a", "Il nome della rosa"), ("b", "Жизнь")), SIGHT).withColumns({"work": F.lit("nome della rosa"), "page": F.lit(1)})
    whole = spark.createDataFrame(sight(("a", "x"), ("c", "Nome della rosa")), SIGHT).drop("language")
    ol = spark.createDataFrame(sight(("d", "The name of the rose", "eng", "978-88")), SIGHT).withColumn("key", F.lit("OL1W"))
    listed, seen, _ = stages.list_editions(w, page, whole, ol)
    assert {(r["id"], r["language"], r["route"]) for r in listed.collect()} == {("a", "ita", "work listing"), ("b", "unknown", "work listing"), ("c", "unknown", "work listing"), ("d", "eng", "work editions")}
    assert [(r["record"], r["language"]) for r in seen.collect()] == [("b", "ita")]
    probes = spark.createDataFrame(sight(("e", "Nome della rosa"), ("f", "Altro libro")), SIGHT)
    sweeps = spark.createDataFrame(sight(("g", "Baudolino")), SIGHT)
    hits = spark.createDataFrame(sight(("h", "Senza titolo", "ita", "97888")), SIGHT)
    got, _, n = stages.recover(w, listed, probes, sweeps, hits.withColumn("isbn", F.lit("97888")))
    assert {(r["id"], r["evidence"], r["refused"]) for r in got.collect()} == {("e", "title match", False), ("f", "refused", True), ("g", "refused", True), ("h", "isbn", False)}
    assert tuple(n.first())[1:3] == (2, 2)
    records = stages.held(listed.unionByName(got, allowMissingColumns=True))
    assert records.count() == 8
    full = spark.createDataFrame([(1, "a", "a", "Il nome della rosa", "ita", [], [], None, "9788845207051"), (1, "c", "zz", "x", "ita", [], [], None, None)], "lookup int, id string, full_id string, title string, language string, translators array<string>, translation_evidence array<string>, statement string, isbn string")
    more, _, e = stages.enrich(w, records, full)
    assert [(r["id"], r["isbn"]) for r in more.collect()] == [("a", "9788845207051")]
    e = e.first()
    assert (e["rows"], e["asked"], e["failed"], e["empty"], e["gained_isbn"], e["truncated"]) == (5, 5, 3, 1, 1, False)


def test_nameless_questions_and_duplicates(spark):
    w = spark.createDataFrame([(1, None, None, None, None, None, None, None, False), (2, None, None, "OL1W", "T", None, None, None, True)], WORK)
    q = spark.createDataFrame([(1, "Il libro"), (2, "T due")], "lookup int, typed_title string")
    probes = spark.createDataFrame(sight(("a", "Il libro"), ("b", "Altro")), SIGHT)
    full = spark.createDataFrame([(1, "a", "eng")], "lookup int, id string, language string")
    got, n = stages.reverse(w, q, probes, probes.limit(1), full)
    assert {(r["id"], r["language"], r["refused"]) for r in got.collect()} == {("a", "eng", False), ("b", "ita", True)} and tuple(n.first())[1:] == (2, 1, 1)
    assert [r["title"] for r in stages.duplicate_queries(w, q).where("lookup = 2").orderBy("pos").collect()] == ["T", "T due"]
    docs = spark.createDataFrame([(2, 0, "OL1W", "T", 0.9, 9, "author name", 1990), (2, 1, "OL2W", "T", 0.7, 3, "author key", None), (2, 2, "OL3W", "U", 0.5, 9, "author name", None)], "lookup int, pos int, key string, title string, score double, edition_count int, by string, year int")
    offered = stages.find_duplicates(w, docs)
    assert [(r["key"], r["editions"], r["by"]) for r in offered.collect()] == [("OL2W", 3, "author key")]
    keys = lambda *k: spark.createDataFrame([(2, x) for x in k], "lookup int, key string")
    eds = spark.createDataFrame(sight(("x", "T")), SIGHT).withColumns({"lookup": F.lit(2), "key": F.lit("OL2W")})
    added, _, unknown = stages.add_duplicates(w, offered, keys("OL2W", "OL9W"), eds, keys().limit(0), keys().limit(0))
    assert [(r["id"], r["via"], r["evidence"]) for r in added.collect()] == [("x", "OL2W", "duplicate work")] and [r["key"] for r in unknown.collect()] == ["OL9W"]


def test_date_checks(spark):
    rec = spark.createDataFrame([(1, "SBN", "a", 1, "ita", "[1980?] 1985", False, None), (1, "SBN", "b", 2, "ita", "1990", False, None), (1, "SBN", "c", 3, "eng", "s.d. 1970 1971", False, None)], "lookup int, source string, id string, seq long, language string, date string, refused boolean, date_indexed array<string>")
    index = spark.createDataFrame([(1, "ita", "1985", "a"), (1, "ita", "1999", "a")], "lookup int, language string, value string, id string")
    lost = spark.createDataFrame([(1, "eng")], "lookup int, language string")
    answers, n = stages.check_dates(rec, index, lost, 2026)
    assert {(r["id"], tuple(r["date_indexed"]), r["date_check_failed"]) for r in answers.collect()} == {("a", ("1985",), False), ("c", (), True)} and tuple(n.first())[1:] == (2, 2, False)
    buckets = spark.createDataFrame([(1, "k", "1990", 0), (1, "k", "1991", 1)], "lookup int, bucket string, value string, results int")
    members = spark.createDataFrame([(1, "k", "b")], "lookup int, bucket string, id string")
    got, n = stages.reconcile(buckets, members, rec, spark.createDataFrame([(1, "k", "1991", "b")], "lookup int, bucket string, value string, id string"), 2026)
    assert [(r["id"], r["date_indexed"]) for r in got.collect()] == [("b", ["1991"])] and tuple(n.first())[1:] == (2, 2, False)


def test_questions(spark):
    q = spark.createDataFrame([("Доктор Живаго", "Пастернак"), ("東京", "x"), ("a/b", "c")], "title string, author string")
    p = identity.prepare(q).select("title", identity.sendable(F.col("title"), F.col("author")), identity.probe_refusal(F.col("title"), F.col("author")), F.size("notes")).collect()
    assert tuple(p[0]) == ("Doktor Zhivago", True, None, 2) and p[1][1] is False and p[1][2].startswith("not Latin") and p[1][3] == 1 and "Solr" in p[2][2]
    arr = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    row = spark.range(1).select(
        identity.author_matches(arr(), F.array(arr("x"))), identity.author_matches(arr("eco"), F.array(arr("a"), arr("eco", "umberto"))), identity.doc_author_agrees(F.array(arr("z")), arr("OL1A"), arr("eco"), arr("/authors/OL1A")),
        identity.same_name(arr("eco", "umberto"), arr("umberto", "eco"), arr("eco"), arr("eco")), identity.same_name(arr("a", "b"), arr("a", "c"), arr("saba"), arr("eco")), identity.worst(arr("ok", "error: x", "down")),
        identity.item_is_work(F.lit(True), F.lit(False)), works.catalogued_title(F.lit("T / by X")),
    ).first()
    assert list(row) == [True, True, "author key", True, False, "error: x", True, "T"]


def test_best_work_and_titles(spark):
    pairs = spark.createDataFrame([("w", "q1", 1.0), ("w", "q2", 1.0), ("v", "q1", 0.7), ("v", "q3", 0.7), ("u", "q1", 0.5), ("t", "q4", 0.8)], "l string, r string, score double")
    names = spark.createDataFrame([("q1", 2), ("q2", 5), ("q3", 1), ("q4", 1)], "r string, n int")
    same = spark.createDataFrame([("q1", "q2"), ("q2", "q1")], "a string, b string")
    parts = spark.createDataFrame([("q9", "q1")], "part string, whole string")
    assert {tuple(r) for r in works.best_work(pairs, names, same, parts).collect()} == {("w", "q2"), ("t", "q4")}
    nested = spark.createDataFrame([("q1", "q2")], "part string, whole string")
    assert {tuple(r) for r in works.best_work(pairs, names, same, nested).collect()} == {("t", "q4")}
    d = spark.createDataFrame([("la rosa <film ; 1986>. -", "{Serie}ep", [1990, 1988])], "label string, title string, years array<int>").select(works.derived_entry(F.col("label"), F.col("title"), F.col("years"), F.lit(3)).alias("d")).first()["d"]
    assert tuple(d) == ("Serie", "film", 1986, True, 3)


def test_language_of_a_work(spark):
    r = spark.createDataFrame([(1, 0.2, False, False), (1, 0.1, True, True), (2, 0.7, False, False), (3, 0.1, True, False), (4, 0.0, False, True)], "work int, affinity double, translated boolean, same boolean")
    got = {x["work"]: x["contradicted"] for x in evidence.work_language_contradicted(r, "work", "affinity", "same").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_headers_and_report(spark):
    e = spark.createDataFrame([(1, "x", 1, "Rosa : romanzo", ["Eco, Umberto"], "ita", "1980", False), (1, "y", 2, "Rose", [], "eng", "1949", True)], "lookup int, edition_id string, seq int, title string, authors array<string>, language string, year string, added boolean")
    w = spark.createDataFrame([(1, None, "ita", 1980, (1980, 9), "Wikidata", {}, [])], "lookup int, original_title string, original_language string, original_year int, original_date struct<year:int,precision:int>, stated_by string, titles map<string,string>, authors array<string>")
    h = rows.headers(e, w)
    r = h.first()
    assert (r["title"], r["authors"], r["earliest_year"], r["total_editions"], r["origin"], r["original_stated"]) == ("Rosa", ["Umberto Eco"], 1980, 1, "first published in italiano, 1980", True)
    spans = spark.createDataFrame([(1, "ita", "italiano", 1, 1, 1980, 1980)], "lookup int, language string, name string, place int, editions int, first_year int, last_year int")
    listed = spark.createDataFrame([(1, "ita", 1, "1980", ["1980", "1985"], "Rosa", "Bompiani", ["Rossi, A"], "978", ["SBN"])], "lookup int, language string, place int, year string, printings array<string>, title string, publisher string, translators array<string>, isbn string, sources array<string>")
    ledger = spark.createDataFrame([(1, "linked", 2)], "lookup int, line string, n int")
    lines = [x["line"] for x in report.work_report(h, spans, listed, ledger).orderBy("lookup", "place").collect()]
    assert lines == ["Rosa / Umberto Eco", "first published in italiano, 1980", "1 edition", "  italiano: 1, 1980", "    1980 (1980, 1985)  Rosa · Bompiani · trans. A Rossi · ISBN 978 · [SBN]", "  2 linked"]


def test_jobs():
    now = [0.0]
    gate = threading.Event()
    make = lambda *s: Job({}, s, lambda j: {"stage": j.stage}, clock=lambda: now[0])
    job = make(Stage("one", lambda j: {"SBN": "ok"}), Stage("two", lambda j: {"SBN": "error: x"}, True), Stage("three", lambda j: {"SBN": "down"}, True))
    job.run()
    assert (job.stage, job.version, job.sources, job.since(1)["snapshot"]) == ("done", 2, {"SBN": "error: x"}, {"stage": "three"}) and job.since(2)["unchanged"]
    assert job.add(lambda j: None) == 3
    bad = make(Stage("one", lambda j: 1 / 0))
    bad.run()
    assert bad.stage == "failed" and bad.error.startswith("ZeroDivisionError") and bad.done
    slow = make(Stage("wait", lambda j: gate.wait(5) and None), Stage("never", lambda j: None))
    with pytest.raises(RuntimeError):
        slow.add(lambda j: None)
    reg = Registry(ttl=10, clock=lambda: now[0])
    key = reg.start(slow)
    assert reg.get(key) is slow and reg.sweep() == 0 and len(reg) == 1
    now[0] = 11.0
    assert reg.sweep() == 1 and slow.cancelled and reg.get(key) is None
    gate.set()
    people = AuthorJob({}, [Stage("list", lambda j: {"SBN": "ok"}, True)], lambda j: j.chosen, clock=lambda: now[0])
    assert people.offer(["a"], True) and people.chosen == ("a",) and not people.offer(["a", "b"], False) and people.stage == "choosing"
    with pytest.raises(KeyError):
        people.choose(["z"], reg.pool)
    people.choose(["b", "b"], reg.pool).result(5)
    assert people.chosen == ("b",) and people.stage == "done"
    reg.close()


def test_keyed_state_of_a_stream(spark, tmp_path):
    from folioforge.streaming.snapshots import stateful_store

    schema = "key string, seq long, note string, route string, refused boolean"
    data = [("k", 1, "", "a", True), ("k", 3, "n", "b", False), ("k", 2, "m", "c", False), ("j", 4, None, "d", True)]
    for i, part in enumerate((data[:1], data[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    import shutil

    (tmp_path / "in").mkdir()
    for i in range(2):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}-{f.name}")
    got = []
    q = stateful_store(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["key"]: (r["seq"], r["note"], r["route"], r["refused"], r["routes"]) for r in got}
    assert last == {"k": (1, "m", "c", False, 3), "j": (4, None, "d", True, 1)}


def test_server(tmp_path):
    import gzip
    import urllib.error
    import urllib.request

    from folioforge.server import serve

    (tmp_path / "index.html").write_text("page")
    (tmp_path.parent / "secret.txt").write_text("no")
    make = lambda q: Job(q | {"append": lambda j, keys: {"added": ",".join(keys)}}, [Stage("one", lambda j: {"SBN": "ok"}, True)], lambda j: {"q": j.question["title"], "long": "x" * 2000})
    reg = Registry()
    server = serve(reg, make, lambda job, key: {"id": key} if key == "e1" else None, port=0, root=tmp_path)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, data=None, **headers):
        body = json.dumps(data).encode() if data is not None else None
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body, headers), timeout=10) as r:
                raw = r.read()
                return r.status, gzip.decompress(raw) if r.headers.get("Content-Encoding") == "gzip" else raw
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    status, body = call("/lookup", {"title": "T", "variants": ["a"]})
    key = json.loads(body)["id"]
    assert status == 202 and json.loads(body)["poll"] == f"/lookup/{key}?v=0"
    while not reg.get(key).done:
        pass
    got = json.loads(call(f"/lookup/{key}?v=0", **{"Accept-Encoding": "gzip"})[1])
    assert got["snapshot"]["q"] == "T" and got["stage"] == "done" and json.loads(call(f"/lookup/{key}?v=1")[1])["unchanged"]
    assert call(f"/lookup/{key}/edition/e1")[0] == 200 and call(f"/lookup/{key}/edition/x")[0] == 404 and call("/lookup/none?v=0")[0] == 404
    assert json.loads(call(f"/lookup/{key}/add", {"keys": ["k"]})[1])["version"] == 2 and call(f"/lookup/{key}/add", {"keys": []})[0] == 400
    assert call(f"/lookup/{key}/choose", {"ids": ["p"]})[0] == 409 and call(f"/lookup/{key}/more", {})[0] == 409
    for bad in ({}, {"title": "T", "variants": ["x"] * 13}, {"title": "T", "title_spellings": 1}, ["no"]):
        assert call("/lookup", bad)[0] == 400
    assert call("/lookup", {"title": "T", "pad": "x" * 70_000})[0] == 400
    assert call("/")[1] == b"page" and call("/..%2Fsecret.txt")[0] == 404 and json.loads(call("/health")[1])["ok"]
    server.shutdown()
    reg.close()


def test_a_whole_run(spark, tmp_path):
    from folioforge.__main__ import arguments, kept
    from folioforge.plans.run import FRAMES, recorded, run_to_end
    from folioforge.sources import files

    put = lambda name, *data: spark.createDataFrame(list(data), FRAMES[name]).write.parquet(f"{tmp_path}/{name}")
    row = lambda i, t, y, code, lang="ita": (1, 0, i, t, lang, [], [], None, "Bompiani", y, y, code, [code] if code else [], ["Eco, Umberto"], "testo", None, None, ["Bompiani"], ["Milano"])
    put("questions", (1, "Il nome della rosa", "Eco"), (2, "Niente", "Nessuno"))
    put("items", (1, 0, "Q1", True, False, True, 1.0, "Il nome della rosa"))
    put("item_facts", ("Q1", "Il nome della rosa", "ita", 1980, (1980, 9), {"ita": "Il nome della rosa", "eng": "The Name of the Rose"}, ["Umberto Eco"]))
    put("guards", (1, 0, "nome della rosa", "strong", False))
    put("listing", (*row("a", "Il nome della rosa", "1980", "9788845207051"), "nome della rosa", 0), (*row("b", "Il nome della rosa", "1985", "88-452-0705-6"), "nome della rosa", 0))
    put("probes", row("c", "The name of the rose", "1983", None, "eng"), row("d", "Baudolino", "2000", None))
    parts = run_to_end(recorded(spark, str(tmp_path)), 2026)
    got = {r["id"]: r for r in parts["rows"].collect()}
    assert set(got) == {"9788845207051", "SBN:c"} and got["9788845207051"]["years_num"] == [1980, 1985] and got["9788845207051"]["printings"] == ["1980", "1985"]
    assert [(s["language"], s["editions"], s["is_original"]) for s in parts["spans"].orderBy("place").collect()] == [("ita", 1, True), ("eng", 1, False)]
    h = parts["headers"].where("lookup = 1").first()
    assert (h["title"], h["authors"], h["earliest_year"], h["total_editions"], h["found"]) == ("Il nome della rosa", ["Umberto Eco"], 1980, 2, True)
    assert [r["id"] for r in parts["band"].collect()] == ["d"] and {r["line"]: r["n"] for r in parts["ledger"].collect()}["linked to this work in SBN"] == 2
    args = arguments([str(tmp_path), "--this-year", "2026", "--year-from", "1981"])
    assert [r["id"] for r in kept(parts["rows"], args).collect()] == ["SBN:c"]
    q = spark.createDataFrame([(1, "T", "A"), (2, "N", None)], "lookup long, query_title string, query_author string")
    flat = files.flat(parts["rows"], q, ["lookup"]).orderBy("query_title", "title").collect()
    assert len(flat) == 3 and flat[0]["title"] is None and flat[1]["sources"] == "SBN" and flat[1].asDict().keys() == set(files.COLUMNS)


def test_uncovered_records_round_halves_to_even(spark, tmp_path):
    import duckdb

    from folioforge.plans import judged
    from folioforge.plans.catalogue import SQL

    orders = [(1, 1, 2500.0), (2, 1, 3500.0), (3, 2, 500.0), (6, 2, 1500.0), (7, None, 2500.0), (4, None, 4000.0), (5, 3, None), (8, 3, 1e9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = judged.uncovered_records(spark, str(tmp_path)).select("author", "total", "covered", "uncovered").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(SQL["uncovered_records"]).fetchall(), key=repr)

from __future__ import annotations

import gzip
import json
import random

from pyspark.sql import functions as F

from folioforge.operators import authors, filters, setjoin, simjoin, store
from folioforge.operators.components import by_shared_key, containment_groups, min_label
from folioforge.plans.lookup import Work, refused_query, snapshot
from folioforge.sources import catalogue, files, parse
from folioforge.streaming.snapshots import Snapshots


def closure(edges):
    group = {x: x for e in edges for x in e}
    for a, b in edges * len(group):
        group[a] = group[b] = min(group[a], group[b])
    return group


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(25)]
    got = {r["node"]: r["label"] for r in min_label(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure(edges)


def test_shared_keys_and_containment(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (3, "c"), (4, None)], "n long, k string")
    assert {(r["node"], r["label"]) for r in by_shared_key(rows, "n", "k").collect()} == {(1, "a"), (2, "a"), (3, "c")}
    sets = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, ["y", "z"]), (4, ["z", "y", "q"]), (5, []), (6, ["x"])], "n long, t array<string>")
    assert {r["node"]: r["group"] for r in containment_groups(sets, "n", "t").collect()} == {1: "x y", 2: "x y", 6: "x y", 3: "q y z", 4: "q y z"}


def test_store_is_free_of_order(spark):
    rows = [("k", 1, "", "r1", True, ["a"]), ("k", 2, "n", "r2", False, ["b", "a"]), ("k", 3, "m", "r3", False, []), ("j", 4, None, "r4", True, None)]
    schema = "key string, seq long, note string, route string, refused boolean, l array<string>"
    want = {("k", 1, 3, "n", "r2", False, ("a", "b")), ("j", 4, 1, None, "r4", True, ())}
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = store.upsert(spark.createDataFrame(order, schema), ["key"], scalars=["note"], lists=["l"], provenance=["route"], refused="refused").collect()
        assert {(r["key"], r["seq"], r["routes"], r["note"], r["route"], r["refused"], tuple(r["l"] or ())) for r in got} == want


def test_blocked_join_equals_the_cross_join(spark):
    rng = random.Random(2)
    data = [(i, [w for w in "abcdefg" if rng.random() < 0.5]) for i in range(60)]
    t = spark.createDataFrame(data, "k long, t array<string>")
    got = {(r["l"], r["r"]) for r in simjoin.token_join(t, t, "k", "k", "t", 0.6).collect()}
    assert got == {(i, j) for i, a in data for j, b in data if a and b and len({*a} & {*b}) / max(len(a), len(b)) >= 0.6}
    plan = simjoin.token_join(t, t, "k", "k", "t", 0.6)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def sets_of(spark, seed, n):
    rng = random.Random(seed)
    made = [[f"w{int(rng.paretovariate(0.4)) % 400}" for _ in range(rng.randrange(1, 60))] for _ in range(n)]
    made += [[w for w in made[i] if rng.random() < 0.9] + ["x"] for i in range(n // 2)] + made[: n // 5] + made[: n // 10] + [["a b"], ["a", "b"], []]
    data = [(i, list(dict.fromkeys(t))) for i, t in enumerate(made)] + [(len(made), None)]
    score = {(i, j): len({*a} & {*b}) / max(len(a), len(b)) for i, a in data for j, b in data if a and b}
    return spark.createDataFrame(data, "k long, t array<string>").repartition(3), {p: s for p, s in score.items() if s >= 0.6}


def test_set_join_shuffles_no_tokens(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 500)
    monkeypatch.setattr(setjoin, "PACK", 200)
    monkeypatch.setattr(setjoin, "HELD", 50)
    t, pairs = sets_of(spark, 4, 60)
    out = setjoin.set_join(t, t, "k", "k", "t", 0.6)
    assert {(r["l"], r["r"]): r["score"] for r in out.collect()} == pairs
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_best_match_of_classes_and_ties(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 400)
    monkeypatch.setattr(setjoin, "PACK", 150)
    t, pairs = sets_of(spark, 9, 60)
    want = {}
    for l in {i for i, _ in pairs}:
        others = {j: s for (i, j), s in pairs.items() if i == l and j != l}
        top = [j for j, s in others.items() if s == max(others.values())]
        want |= {l: (top[0], others[top[0]])} if len(top) == 1 else {}
    assert {r["l"]: (r["r"], r["score"]) for r in setjoin.best_match(t, "k", "t", 0.6).collect()} == want and want


def test_best_match_keeps_no_pair_of_a_group_but_the_best(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HELD", 100)
    kept, tops = [], setjoin.tops
    monkeypatch.setattr(setjoin, "tops", lambda *a: kept.append(tops(*a)) or kept[0])
    rng = random.Random(3)
    data = [(i, list({f"w{j}" for j in range(40)} - {f"w{rng.randrange(40)}", f"w{rng.randrange(40)}"}) + [f"v{rng.randrange(9)}"]) for i in range(200)]
    found = setjoin.best_match(spark.createDataFrame(data, "k long, t array<string>").repartition(2), "k", "t", 0.6).collect()
    want = {}
    for i, a in data:
        score = {j: len({*a} & {*b}) / max(len(a), len(b)) for j, b in data if j != i}
        top = [j for j, s in score.items() if s == max(score.values())]
        want |= {i: (top[0], score[top[0]])} if len(top) == 1 else {}
    assert {r["l"]: (r["r"], r["score"]) for r in found} == want and want
    rows = kept[0].groupBy("l").count().collect()
    assert sum(r["count"] for r in rows) <= 2 * 2 * 2 * len(data)  # not the 20,000 pairs at the threshold


def test_sets_meet_only_if_they_share_enough_rare_tokens(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    each = [np.append(rng.choice(2000, 90, replace=False), i + 5000) for i in range(300)]  # any two share a few, and none enough
    each += [np.append(e[:70], rng.choice(2000, 20, replace=False) + 9000) for e in each[:9]]
    code = lambda e: (e.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    need = lambda n: n - setjoin._overlap(n, 0.6) + setjoin._shared(n, 0.6)
    rows, compared, inner = [], [], setjoin._compared
    for i, e in enumerate(each):
        h = code(e)
        prefix = np.sort(h >> np.uint64(32)).astype(np.uint32)[: need(np.array([len(h)]))[0]]
        rows.append({c: np.array(v, kind).tobytes() for c, v, kind in (("k", [i], np.int64), ("n", [len(h)], np.int32), ("p", prefix, np.uint32), ("o", np.zeros(len(prefix)), np.uint16), ("h", h, np.uint64))})
    monkeypatch.setattr(setjoin, "_compared", lambda x, y, a, b: compared.append(len(a)) or inner(x, y, a, b))
    x = setjoin.Ranked(rows)
    got = {(int(x.k[i]), int(x.k[j])): s for a, b, s in setjoin._before(x, setjoin.Ranked(rows).by_token(), 0.6) for i, j, s in zip(a, b, s, strict=True)}
    share = lambda a, b: len({*a.tolist()} & {*b.tolist()}) / max(len(a), len(b))
    order = sorted(range(len(each)), key=lambda i: (len(each[i]), i))
    assert got == {(i, j): s for p, i in enumerate(order) for j in order[:p] if (s := share(each[i], each[j])) >= 0.6} and len(got) == 9
    assert sum(compared) < 1000  # of 47,586 pairs, most of which share a prefix token


def test_long_sets_queries_deal_nothing_by_token(spark):
    from folioforge.plans import catalogue

    for name in ("best_match_no_tie", "title_gate"):
        assert "explode(" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_titles_join_authors_sources(spark):
    side = lambda rows: simjoin.with_tokens(spark.createDataFrame(rows, "key string, title string"), "title")
    works = side([("w1", "Il nome della rosa"), ("w2", "Baudolino"), ("w3", "東京")])
    items = side([("q1", "Nome della rosa: romanzo"), ("q2", "東京")])
    docs = side([("d1", "Baudolino"), ("d2", "Kant e l'ornitorinco"), ("d3", "東京")])
    rows, band = authors.join_sources(works, items, docs)
    assert {(r["row"], r["works"], r["docs"]) for r in rows.collect()} == {("item:q1", 1, 0), ("item:q2", 1, 1), ("work:w2", 1, 1)}
    assert [r["key"] for r in band.collect()] == ["d2"]


def test_reasons_sum_to_what_is_hidden(spark):
    rows = spark.createDataFrame([("ita", [1980], ["a"]), ("unknown", [1980], ["a"]), ("eng", [1980], ["a"]), ("ita", [], ["a"]), ("ita", [1900, 1999], ["a"]), ("ita", [1980], ["b"])], "l string, y array<int>, p array<string>")
    shown, hidden = filters.apply(rows, filters.why(F.col("l"), F.col("y"), F.col("p"), ["ita"], 1970, 1990, ["a"]))
    assert shown.count() == 1 and {r["reason"]: r["hidden"] for r in hidden.collect()} == {"no-language": 1, "other-language": 1, "no-year": 1, "outside-years": 1, "other-publisher": 1}


def test_lookup_snapshot(spark):
    schema = "source string, id string, seq long, route string, title string, publisher string, year string, isbn string, physical string, medium string, date string, language string, isbns_raw array<string>, authors array<string>, translators array<string>"
    r = lambda s, i, n, route, t, y, code, lang: (s, i, n, route, t, "Einaudi", y, code, "200 p.", None, None, lang, [code] if code else [], ["Eco, Umberto"], [])
    rows = [
        r("SBN", "a", 1, "work listing", "Il nome della rosa", "1980", "9788845207051", "ita"), r("Open Library", "b", 2, "title probe", "Nome della rosa", "1985", "978-88-452-0705-1", "ita"),
        r("SBN", "c", 3, "title probe", "Un altro libro", "1990", None, "ita"), r("SBN", "d", 4, "title probe", "Name of the rose", "1983", None, "eng"), r("SBN", "a", 5, "author sweep", "x", "1999", None, "unknown"),
    ]
    parts = {k: v.collect() for k, v in snapshot(spark.createDataFrame(rows, schema), Work(["Il nome della rosa", "The name of the rose"], "ita", 1980), 2026).items()}
    assert {(e["edition_id"], e["records"], e["year"], e["latest"]) for e in parts["editions"]} == {("9788845207051", 2, "1980", "1985"), ("SBN:d", 1, "1983", "1983")}
    assert [(s["language"], s["editions"], s["is_original"]) for s in sorted(parts["spans"], key=lambda s: s["place"])] == [("ita", 1, True), ("eng", 1, False)]
    assert [b["id"] for b in parts["band"]] == ["c"] and parts["earliest"][0]["year"] == 1980 and parts["facets"][0]["editions"] == 2
    assert refused_query("a/b", "c") and refused_query("東京", "x") and not refused_query("Живаго", "Пастернак")


def test_recorded_catalogue(spark, tmp_path):
    for k, p, body in (("q", 1, {"data": {"total": 2, "results": [{"id": "ABC0123456", "type": "testo", "title": {"info": "{Opere}1. Uno / di X", "text": "X, Y"}, "infos": ["12. rist", "Testo - Monografia [IT\\ICCU\\X]", "Milano : Bompiani, 1980"]}, {"id": "?"}]}}), ("q", 2, {"error": {"msg": "down"}})):
        with gzip.open(tmp_path / f"{k}-{p}.json.gz", "wt") as f:
            json.dump(body, f)
    (tmp_path / "manifest.json").write_text(json.dumps({"pages": {"q": 2}}))
    catalogue.register(spark)
    got = spark.read.format("catalogue").option("path", str(tmp_path)).load()
    assert {(r["page"], r["error"]) for r in got.collect()} == {(1, None), (2, "down")}
    assert [r["page"] for r in got.where("page = 2").collect()] == [2]
    rec = parse.listing_records(got.where("error is null"), "ita").collect()
    assert [(r["id"], r["title"], r["publisher"], r["year"], r["authors"], r["medium"], r["level"], r["places"]) for r in rec] == [("ABC0123456", "Opere. 1. Uno", "Bompiani, Milano", "1980", ["X, Y"], "testo", "Monografia", ["Milano"])]
    assert catalogue.request_key("u", {"b": 1, "a": 2}) == catalogue.request_key("u", {"a": 2, "b": 1})


def test_raw_bodies(spark):
    brief = json.dumps({"codiceIdentificativo": "IT\\ICCU\\CFI\\0123456", "titolo": "Opera / di A", "pubblicazione": "Roma : Laterza, 1999", "nomi": ["[Autore] Rossi, A", "[Traduttore] Bianchi"], "linguaPubblicazione": "ITALIANO", "classificazioneDewey": "853.914 (21.)"})
    r = parse.brief_records(spark.createDataFrame([(brief,)], "body string")).first()
    assert (r["id"], r["title"], r["publisher"], r["year"], r["language"], r["authors"], r["translators"], r["dewey"]) == ("CFI0123456", "Opera", "Laterza, Roma", "1999", "ita", ["Rossi, A"], ["Bianchi"], "853.914")
    item = json.dumps({"labels": {"it": {"value": "Rosa"}, "xx": {"value": "R"}}, "claims": {"P577": [{"rank": "normal", "mainsnak": {"datavalue": {"value": {"time": "+1980-00-00T00:00:00Z", "precision": 9}}}}], "P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q7725634"}}}}]}})
    e = parse.entities(spark.createDataFrame([("Q1", item)], "qid string, body string")).first()
    assert (e["labels"], e["original_year"], e["precision"], e["kinds"]) == ({"it": "Rosa"}, 1980, 9, ["Q7725634"])


def test_books_file(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# c\nA | B\n\nOnly\n")
    assert [tuple(r) for r in files.read_books(spark, str(tmp_path / "b.txt")).collect()] == [("A", "B"), ("Only", None)]


def test_any_cut_into_batches_ends_in_the_batch_answer(spark, tmp_path):
    rows = [(f"k{i % 5}", i, "" if i % 3 else f"n{i}", i % 2 == 0) for i in range(40)]
    schema = "key string, seq long, note string, refused boolean"
    derive = lambda t: store.upsert(t, ["key"], scalars=["note"], refused="refused")
    want = sorted(map(tuple, derive(spark.createDataFrame(rows, schema)).collect()))
    for cut in (1, 3):
        folder = tmp_path / f"c{cut}"
        for b in range(cut):
            spark.createDataFrame(rows[b::cut], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = Snapshots(spark, f"{folder}/out", derive)
        s.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).awaitTermination(120)
        assert s.version() >= 1 and s.since(s.version()) is None
        got = s.since(0).select("key", "seq", "routes", "note", "refused")
        assert sorted(map(tuple, got.collect())) == want


def test_labels_and_people(spark):
    from folioforge.operators import evidence

    t = spark.createDataFrame([([("Jose Marti", "jose marti"), ("Eco", "eco"), ("José Martí", "jose marti")], "Marti, José", "ita", ["Rossi"], "tradotto dal russo")], "n array<struct<name:string,key:string>>, a string, l string, tr array<string>, s string")
    row = t.select(
        evidence.add_author(F.col("n")), evidence.credited_to_another(F.array("a"), F.array(F.lit("jose"), F.lit("marti")), F.array(F.array(F.lit("eco")))),
        evidence.credited_to_another(F.array("a"), F.array(F.lit("jose"), F.lit("marti")), F.array(F.array(F.lit("marti")))), evidence.language_contradicts_itself(F.col("l"), "ita", F.col("tr"), F.col("s")),
        evidence.language_contradicts_itself(F.col("l"), "rus", F.col("tr"), F.col("s")), evidence.medium_of(F.lit("Il nome della rosa <film ; 1986>")), evidence.medium_of(F.lit("Il nome")),
    ).first()
    assert list(row) == [["José Martí", "Eco"], "José Marti", None, True, False, "film", None]

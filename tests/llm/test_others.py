"""Chat formatting, search and sharding."""

from __future__ import annotations

import collections
import json
import math
import random
import threading

import numpy as np
import pytest

from folioforge.llm.chat_format import CALLS, canonical, check_schema, exchanges, link_calls, plain, problems
from folioforge.llm.multi_index import multi_index_search
from folioforge.llm.sharding import ShardStore, shard
from tests.llm.fixtures import SCHEMA, rows

MESSAGES = "conv_id long, turn long, role string, text string"


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    messages = spark.createDataFrame([(1, 0, "user", "hé"), (1, 1, "assistant", None), (2, 0, "user", "")], MESSAGES)
    calls = spark.createDataFrame([
        (1, 1, 0, "x", "add", '{"a": 1}', ["y"]), (1, 1, 1, "y", "add", '{"b":2}', []), (1, 1, 2, "z", "sub", "{}", ["x"]),
        (1, 1, 3, "x", "add", '{"a":3}', None), (2, 0, 0, "p", "add", '{"a":-1}', ["q"]), (2, 0, 1, "q", "add", "[1]", ["p"]), (2, 0, 2, None, "add", None, None),
    ], CALLS)
    results = spark.createDataFrame([(1, 2, "x", "one"), (1, 3, "x", "again"), (2, 1, "nobody", "?")], "conv_id long, turn long, call_id string, text string")
    got = {(r["conv_id"], r["turn"], r["at"], r["kind"]): r for r in link_calls(messages, calls, results, schema).collect()}
    assert len(got) == 13
    level = {k[:3]: r["level"] for k, r in got.items() if k[3] == "call"}
    assert level[1, 1, 1] == 0 and level[1, 1, 0] == 1 and level[1, 1, 2] == 0 and level[2, 0, 0] == level[2, 0, 1] == 2**31 - 1
    after = {k[:3]: (r["after_turn"], r["after_at"]) for k, r in got.items() if k[3] == "call"}
    assert after[1, 1, 0] == after[1, 1, 1] == (1, 1) and after[1, 1, 2] == (1, 2)
    x = got[1, 1, 0, "call"]
    assert x["linked"] and x["valid"] and x["json"] == '{"arguments":{"a":1},"id":"x","name":"add","type":"call"}'
    assert got[1, 1, 1, "call"]["errors"] == ["$.a: missing", "$.b: unknown"] and not got[1, 1, 3, "call"]["linked"]
    assert got[1, 1, 2, "call"]["errors"] == ["unknown tool"] and "circular" in got[2, 0, 1, "call"]["errors"]
    assert got[1, 2, 0, "result"]["linked"] and not got[1, 3, 0, "result"]["linked"] and not got[2, 1, 0, "result"]["linked"]
    assert got[1, 0, 0, "message"]["json"] == '{"content":"hé","role":"user","type":"message"}'
    assert problems({"a": True}, schema["add"]) == ["$.a: not integer"]
    assert canonical({"b": [1, {"d": 1, "c": None}], "a": "ü"}) == '{"a":"ü","b":[1,{"c":null,"d":1}]}'


def ordered(needs: dict[int, list[int]], got: dict[int, tuple]) -> bool:
    """Whether every call comes after all it needs, among calls that aren't in a circle."""
    return all(got[n] < got[c] for c, ns in needs.items() for n in ns if n in needs and got[c][2] < 2**31 - 1)


@pytest.mark.parametrize("shape", ["back", "forward", "random", "circles"])
def test_calls_are_put_in_order(spark, shape):
    n, rng = {"back": 10_000, "forward": 300}.get(shape, 60), random.Random(5)
    if shape in ("back", "forward"):
        needs = {i: [i + (1 if shape == "forward" else -1)] for i in range(n)}
    else:
        rank = list(range(n))
        rng.shuffle(rank)
        needs = {i: [j for j in rng.sample(range(n), rng.randint(0, 3)) if shape == "circles" or rank[j] < rank[i]] for i in range(n)}
    rows_ = [(1, i, 0, str(i), "f", "{}", [str(x) for x in ns] + ["none"]) for i, ns in needs.items()]
    messages = spark.createDataFrame([], MESSAGES)
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, text string")
    found = link_calls(messages, spark.createDataFrame(rows_, CALLS), results, {"f": {}}).collect()
    got = {r["turn"]: (r["after_turn"], r["after_at"], r["level"], r["turn"]) for r in found}
    assert len(got) == n and ordered(needs, got)
    reach = {i: set(ns) & needs.keys() for i, ns in needs.items()}
    if n <= 60:
        for _ in range(n):
            reach = {i: x.union(*(reach[j] for j in x)) for i, x in reach.items()}
        bad = {i for i, x in reach.items() if i in x}
        bad |= {i for i, x in reach.items() if x & bad}
        assert bad == {i for i, x in got.items() if x[2] == 2**31 - 1} and (not bad or shape == "circles")
        assert all(x[0] == max([i, *reach[i]]) for i, x in got.items() if i not in bad)
    else:
        assert all(x[0] == (n - 1 if shape == "forward" else i) for i, x in got.items())


def test_arguments_that_are_no_json(spark):
    bad = ["[" * 200_000, '{"a":' * 300 + "1" + "}" * 300, '{"a": NaN}', '{"a": 1e999}', '{"a": ' + "9" * 5000 + "}", "", None, "x"]
    good = ['{"a": "\\ud800x"}', '{"a": 1.0}', '{"b": 1, "a": "é"}']
    rows_ = [(1, i, 0, str(i), "f", x, None) for i, x in enumerate(bad + good)]
    none = spark.createDataFrame([], MESSAGES), spark.createDataFrame([], "conv_id long, turn long, call_id string, text string")
    got = {r["turn"]: r for r in link_calls(none[0], spark.createDataFrame(rows_, CALLS), none[1], {"f": {"type": "object"}}).collect()}
    for i, x in enumerate(bad):
        assert not got[i]["valid"] and json.loads(got[i]["json"])["arguments"] == x
    texts = [json.loads(got[len(bad) + i]["json"])["arguments"] for i in range(3)]
    assert texts == [{"a": "\ufffdx"}, {"a": 1}, {"a": "é", "b": 1}] and all(got[len(bad) + i]["valid"] for i in range(3))
    assert '"arguments":{"a":1}' in got[len(bad) + 1]["json"]


def test_schemas():
    ok = lambda value, schema: not problems(plain(value), schema)
    assert ok(1.0, {"type": "integer"}) and not ok(True, {"enum": [1]}) and ok(1, {"enum": [1.0]}) and not ok(True, {"type": "number"})
    assert ok(4, {"multipleOf": 2}) and not ok(4, {"exclusiveMaximum": 4}) and not ok("ab", {"pattern": "^b"}) and not ok([1, 1.0], {"uniqueItems": True})
    assert ok({"x": 1}, {"additionalProperties": {"type": "integer"}}) and not ok({"x": "1"}, {"additionalProperties": {"type": "integer"}})
    assert ok(3, {"anyOf": [{"type": "string"}, {"minimum": 2}]}) and not ok(3, {"not": {"minimum": 2}}) and not ok(3, {"oneOf": [{}, {"minimum": 2}]})
    for schema in ({"type": "date"}, {"dependentRequired": {}}, {"properties": {"a": {"type": "number", "limit": 3}}}):
        with pytest.raises(ValueError):
            check_schema(schema)


def test_exchanges_of_plain_conversations(spark):
    data = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t}") for c in range(4) for t in range(6)] + [(9, None, "user", None), (None, 0, "user", "x")]
    messages = spark.createDataFrame(data, MESSAGES)
    from folioforge.llm.chat_format import REPLY

    got = link_calls(messages, *exchanges(messages), REPLY).collect()
    calls = [r for r in got if r["kind"] == "call" and r["conv_id"] is not None and r["conv_id"] < 4]
    titles = [r for r in calls if r["call_id"] == "title"]
    assert [(r["turn"], r["after_at"], r["level"], r["valid"], r["linked"]) for r in titles] == [(4, 0, 1, True, False)] * 4
    calls = [r for r in calls if r["call_id"] != "title"]
    assert len(calls) == 12 and all(r["linked"] and r["valid"] and r["level"] == 0 for r in calls)
    assert all(json.loads(r["json"]) for r in got)
    none = messages.limit(0)
    assert link_calls(none, *exchanges(none), REPLY).count() == 0


def brute(data, every=50, k=5):
    out = {}
    ok = {}
    for i, v in data:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(v)
    for q, own in ok.items():
        if q % every:
            continue
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))  # noqa: B905, E731
        near = sorted((-max(cos(a, b) for a in own for b in vs), i) for i, vs in ok.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def vectors(n, seed=1):
    rng = random.Random(seed)
    f = lambda x: round(x * 64) / 64  # noqa: E731 exact in float
    data = [(i, [f(rng.gauss(0, 1)) for _ in range(8)]) for i in range(n)]
    data += [(n, None), (n + 1, [0.0] * 8), (n + 2, [1.0] * 7), (n + 3, [None] + [1.0] * 7), (n + 4, [math.nan] * 8), (n + 5, [math.inf] * 8), (None, [1.0] * 8)]
    return data + [data[3], data[0], (n + 6, data[3][1]), (n + 7, data[3][1])]


@pytest.mark.parametrize("n", [3, 400])
def test_search(spark, n):
    table = spark.createDataFrame(vectors(n), "vec_id long, embedding array<float>")
    got = {}
    for r in multi_index_search(table, parts=2, width=8, key_rows=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    expected = brute(vectors(n))
    assert got.keys() == expected.keys()
    hit = total = 0
    for q, near in expected.items():
        assert sorted(got[q]) == list(range(1, len(near) + 1))
        true = dict(near)
        for v, s in got[q].values():
            assert v not in true or math.isclose(s, true[v], abs_tol=1e-12)
        hit += len({v for v, _ in got[q].values()} & true.keys())
        total += len(near)
    assert hit >= 0.9 * total
    assert multi_index_search(table.limit(0)).count() == 0


def test_search_of_clusters(spark):
    """Clustered vectors: the radius is small, keys few, a hot vector is split, and recall stays."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    x = np.round((np.repeat(centres, 40, 0) + 0.2 * rng.normal(size=(2400, 8))) * 64) / 64
    x[:600] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in multi_index_search(table, parts=4, width=6, key_rows=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2400, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        true = np.sort(cos)[-5:][::-1]
        assert len(got[q]) == 5
        hit += sum(math.isclose(s, t, abs_tol=1e-9) for (_, s), t in zip(got[q], true, strict=True))
    assert [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert hit >= 0.9 * 48 * 5


def test_sharding(spark, tmp_path):
    data = spark.createDataFrame(rows(200), SCHEMA).repartition(4)
    store, version = shard(data, f"file://{tmp_path}/s", target=20_000, shard_rows=10, smallest=1000)
    assert version > 1
    first, last = store.manifest(1), store.manifest(version)
    assert last.count() < first.count()
    assert first.agg({"rows": "sum"}).first()[0] == last.agg({"rows": "sum"}).first()[0] == data.count()
    for v in (1, version):
        assert sorted(map(repr, store.read(data.schema, v).collect())) == sorted(map(repr, data.collect()))
    with pytest.raises(RuntimeError):
        store.commit(last, version - 1)
    assert not store.fs.exists(store._path(f"file://{tmp_path}/s/pending")) or not store.fs.listStatus(store._path(f"file://{tmp_path}/s/pending"))
    assert store.append(data.limit(3), 10, 1000, 4) == version + 1
    assert store.read(data.schema).count() == data.count() + 3
    nothing, v = shard(data.limit(0), f"file://{tmp_path}/e")
    assert nothing.read(data.schema, v).count() == 0
    assert ShardStore(spark, f"file://{tmp_path}/none").read(data.schema).count() == 0


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    """Both look before either commits; each commit makes its file in one act."""
    data = spark.createDataFrame(rows(20), SCHEMA)
    store, version = shard(data, f"file://{tmp_path}/s", shard_rows=5, smallest=100, target=1 << 20)
    live = store.manifest(version)
    won = []

    def write(name: str) -> None:
        try:
            store._claim(version + 1, name)
            won.append(name)
        except RuntimeError:
            pass

    writers = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and store._named(version + 1) == won[0]
    with pytest.raises(RuntimeError):
        store.commit(live, version)


def test_vacuum(spark, tmp_path):
    data = spark.createDataFrame(rows(60), SCHEMA).repartition(3)
    store, version = shard(data, f"file://{tmp_path}/s", shard_rows=7, smallest=100, target=1 << 20)
    assert version > 1 and store.vacuum(version) == 0
    assert store.vacuum() > 0 and store.read(data.schema).count() == data.count()

"""The document operators against brute force, on awkward rows and on an empty table."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.llm import queries as Q
from folioforge.llm.bpe import bpe_round_trip
from folioforge.llm.line_dedup import line_dedup
from folioforge.llm.mixing import mix_plan, mix_sources
from folioforge.llm.ngram_join import ngram_components, ngram_join
from folioforge.llm.quality_classifier import quality_classifier
from folioforge.llm.quality_rules import quality_rules
from folioforge.llm.suffix_dedup import suffix_dedup
from tests.llm.fixtures import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(found, names):
    return sorted(((r["doc_id"], *(r[n] for n in names)) for r in found), key=repr)


def test_bpe_is_the_tokenizers_librarys(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary_path())
    got = bpe_round_trip(docs, Q.vocabulary_path()).collect()
    expected = []
    for d, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    assert by_row(got, ["ids", "decoded"]) == sorted(expected, key=repr)
    assert bpe_round_trip(empty, Q.vocabulary_path()).count() == 0


def longest(words: list[str], least: int = 5) -> int:
    n = len(words)
    table, best = [0] * (n + 1), 0
    for i in range(n - 1, -1, -1):
        new = [0] * (n + 1)
        for j in range(n - 1, i, -1):
            if words[i] == words[j]:
                new[j] = table[j + 1] + 1
                best = max(best, new[j])
        table = new
    return best if best >= least else 0


def test_quality_rules(docs, empty):
    got = quality_rules(docs)
    assert "n_lines" in got.columns
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed"]
    expected = []
    for d, text, *_ in rows():
        w = WORD.findall(text or "")
        n = len(w)
        count = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
        cover = {i + k for i in range(n - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        top = 2999 if d == 207 else longest(w) if n < 800 else None
        failed = n < 10 or 100 * len(cover) > 20 * n
        expected.append((d, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), top, failed))
    found = [list(r) for r in by_row(got.collect(), names)]
    for a, b in zip(found, sorted(expected, key=repr), strict=True):
        assert a == [x if x is not None else y for x, y in zip(b, a, strict=True)]
    assert all(not r["kept"] for r in got.where("base_failed").collect())
    assert quality_rules(empty).count() == 0


def line_oracle(data, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    held = collections.defaultdict(set)
    for d, text, *_ in data:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(d)
    gone = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= docs}
    out = []
    for d, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and gone[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), text if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [4, 16])
def test_line_dedup_at_any_fill_of_the_filters(docs, bits):
    got = line_dedup(docs, log2_bits=max(bits, 6))
    assert got.columns[:5] == docs.columns[:5]
    assert by_row(got.collect(), ["n_lines", "n_dropped", "text"]) == line_oracle(rows())


def test_line_dedup_of_nothing(empty):
    assert line_dedup(empty, log2_bits=10).count() == 0


def components_oracle(data, width=3, percent=90):
    sets = []
    for _, text, *_ in data:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for g, (d, *_) in zip(group, data, strict=True):
        ids[g].append(d)
    return sorted(((d, len(s), min([x for x in ids[g] if x is not None], default=None)) for g, s, (d, *_) in zip(group, sets, data, strict=True)), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(docs, width, percent):
    got = ngram_components(docs, width, percent, sketch_bits=14, log2_bits=10)
    assert by_row(got.collect(), ["n_shingles", "component_id"]) == components_oracle(rows(), width, percent)


@pytest.mark.parametrize("block", [2, 1024])
def test_ngram_join_splits_crowded_ngrams(docs, block):
    got = ngram_components(docs, 3, 90, sketch_bits=8, log2_bits=10, block=block)
    assert by_row(got.collect(), ["n_shingles", "component_id"]) == components_oracle(rows())


def test_ngram_join_keeps_one_of_each(docs, empty):
    got = ngram_join(docs, 3, 90, sketch_bits=14, one_each=True).collect()
    wanted = {x[2] for x in components_oracle(rows()) if x[0] is not None}
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(wanted)
    assert ngram_join(empty, sketch_bits=14).count() == 0


def removal_oracle(data, length=200):
    texts = [(t or "").encode() for _, t, *_ in data]
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, *_), t in zip(data, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "hot"), [(200, 4096), (200, 1), (30, 4096)])
def test_suffix_dedup(docs, length, hot):
    got = suffix_dedup(docs, length, log2_bits=16, hot=hot).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr)
    assert found == removal_oracle(rows(), length)


def test_windows_of_near_copies_are_counted_without_a_join(spark, monkeypatch):
    from folioforge.llm import common

    plans, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    near = [(i, "".join(rng.choice("XYZ") if rng.random() < 0.004 else c for c in base)) for i in range(40)]
    data = [*near, (40, near[0][1]), (41, base[:500]), (41, base[:500]), (42, None)]
    got = suffix_dedup(spark.createDataFrame(data, "doc_id long, text string"), 200, log2_bits=16, hot=4).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr)
    assert found == removal_oracle(data)
    assert any(0 < r[2] < r[1] for r in found) and not any("LeftSemi" in p for p in plans)


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup(empty, log2_bits=10).count() == 0


def test_mixing(docs, empty):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows())
    size = lambda t: len(WORD.findall(t or ""))
    per = collections.Counter()
    for _, t, _, s, *_ in rows():
        per[s] += size(t)
    names = sorted((x for x in per if x is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(per.values()))
    while True:
        level = rest / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if weight[s] * level > 3 * per[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * per[s]
            rest -= 3 * per[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    taken, biggest = collections.Counter(), max(size(t) for _, t, *_ in rows())
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == per[r["source"]]
        assert math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= biggest
    assert by_row(got, ["taken"]) == by_row(mix_sources(docs.repartition(5)).collect(), ["taken"])
    assert by_row(got, ["taken", "target"]) == by_row(mix_plan(docs).collect(), ["taken", "target"])
    assert all(r["taken"] == r["size"] * r["copies"] for r in got)
    assert mix_sources(empty).count() == 0


def test_mixing_of_repeated_rows(spark):
    """Sixty equal rows of ten words beside another source, so that half of the words are wanted."""
    text = "one two three four five six seven eight nine ten"
    table = spark.createDataFrame([(1, text, "a")] * 60 + [(2 + i, text, "b") for i in range(10)], "doc_id long, text string, source string").repartition(3)
    for got in (mix_sources(table, weights=(1, 1)).collect(), mix_plan(table, weights=(1, 1)).collect()):
        target = {r["source"]: r["target"] for r in got}
        for s in "ab":
            assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 5
        assert 0 < target["a"] < 600


def test_quality_classifier(spark, docs, empty):
    prose = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(40)), 1) for i in range(150)]
    junk = [(1000 + i, " ".join([f"q{i}"] * 30) + " ### $$$", 0) for i in range(150)]
    table = spark.createDataFrame([x[:2] for x in prose + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in prose + junk] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier(table, labels).collect()}
    for d, _, q in prose + junk:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert got[d]["predicted"] == q and 0 <= got[d]["score"] <= 1
    odd = quality_classifier(docs, labels).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier(empty, labels).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    data = docs.select("doc_id", "text", "lang", "source", F.col("n_chars"))
    data.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == data.columns and 0 < kept.count() < data.count()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out
    texts = collections.Counter(r["decoded_sha256"] for r in out)
    assert max(texts.values()) <= 3
    after = line_oracle([tuple(r) for r in kept.collect()])
    after = [(d, t) for d, _, _, t in after]
    first = {d for d, _, c in components_oracle(after, 5, 80) if d == c} | {None}
    assert {r["doc_id"] for r in out} <= first
    digest = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after}
    assert all(r["decoded_sha256"] == digest[r["doc_id"]] for r in out)

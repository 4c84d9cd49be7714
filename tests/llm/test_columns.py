"""Every document operator beside columns of odd and of clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioforge.llm import queries as Q
from folioforge.llm.bpe import bpe_round_trip
from folioforge.llm.line_dedup import line_dedup
from folioforge.llm.mixing import mix_sources
from folioforge.llm.ngram_join import ngram_join
from folioforge.llm.quality_classifier import quality_classifier
from folioforge.llm.quality_rules import quality_rules
from folioforge.llm.sharding import shard
from folioforge.llm.suffix_dedup import suffix_dedup

OPERATORS = {
    "bpe": (lambda d: bpe_round_trip(d, Q.vocabulary_path()), "IDS"),
    "quality_rules": (quality_rules, "N_Words"),
    "line_dedup": (lambda d: line_dedup(d, log2_bits=12), "N_DROPPED"),
    "quality_classifier": (lambda d: quality_classifier(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))), "Score"),
    "mixing": (mix_sources, "TAKEN"),
    "ngram_join": (lambda d: ngram_join(d, sketch_bits=12, log2_bits=10), "Component_ID"),
    "suffix_dedup": (lambda d: suffix_dedup(d, 40, log2_bits=12), "Kept"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_clashing_names(spark, name):
    operator, clash = OPERATORS[name]
    data = [(i, f"some words of text number {i % 3} and the rest of it\nand a line that all documents share", "s", "old", i * 10, {"b c": i}) for i in range(6)]
    struct = "struct<`b c`:long>"
    table = spark.createDataFrame([(*x[:5], (x[5]["b c"],)) for x in data], f"doc_id long, text string, source string, `{clash}` string, `a.b` long, `od d` {struct}")
    plain = operator(table.select("doc_id", "text", "source"))
    got = operator(table)
    new = [c for c in plain.columns if c not in ("doc_id", "text", "source")]
    assert got.columns == ["doc_id", "text", "source", "a.b", "od d", *new]
    rows = {r["doc_id"]: r for r in got.collect()}
    for r in plain.collect():
        own = rows[r["doc_id"]]
        assert [own[c] for c in new] == [r[c] for c in new] and own["text"] == r["text"]
        assert own["a.b"] == 10 * r["doc_id"] and own["od d"]["b c"] == r["doc_id"]


def test_sharding_of_odd_names(spark, tmp_path):
    table = spark.createDataFrame([(1, "x", (2,))], "doc_id long, `a.b` string, `od d` struct<`b c`:long>")
    store, version = shard(table, f"file://{tmp_path}/s")
    assert store.read(table.schema, version).collect() == table.collect()


def test_structured_strings_do_not_collide(spark):
    """Thue-Morse strings, which polynomial hashes modulo 2**64 take for equal, as words and as lines."""
    signs = [0]
    while len(signs) < 2048:
        signs += [1 - s for s in signs]
    a, b = ("".join("ab"[s ^ flip] for s in signs) for flip in (0, 1))
    table = spark.createDataFrame([(1, f"{a}\n{b}"), (2, a), (3, b), (4, f"{b}\n{a}"), (5, f"{a} {b}"), (6, f"{a}\n{a}")], "doc_id long, text string")
    dup = {r["doc_id"]: r["n_dup_lines"] for r in quality_rules(table).collect()}
    assert dup == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
    group = {r["doc_id"]: r["component_id"] for r in ngram_join(table, sketch_bits=12, log2_bits=10).collect()}
    assert group == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6}
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup(table, log2_bits=12).collect()}
    assert lines == {1: (2, 2), 2: (1, 1), 3: (1, 1), 4: (2, 1), 5: (1, 0), 6: (2, 0)}
    from folioforge.llm.suffix_dedup import suffix_dedup as dedup

    gone = {r["doc_id"]: r["n_removed"] for r in dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), 1500, log2_bits=12).collect()}
    assert gone == {1: 0, 2: 0}

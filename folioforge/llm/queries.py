"""The queries of this subpackage for ``__spark_entry__.py``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe import bpe_round_trip
from folioforge.llm.chat_format import REPLY, exchanges, link_calls
from folioforge.llm.line_dedup import line_dedup
from folioforge.llm.mixing import mix_plan
from folioforge.llm.multi_index import multi_index_search
from folioforge.llm.ngram_join import ngram_components
from folioforge.llm.quality_classifier import quality_classifier
from folioforge.llm.quality_rules import NAMES as QUALITY_NAMES
from folioforge.llm.quality_rules import quality_rules

from folioforge.llm.sharding import shard
from folioforge.llm.suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_round_trip(docs, vocabulary_path())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *[c for c in QUALITY_NAMES if c != "repeat_spans"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_shingles", "component_id")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = link_calls(messages, *exchanges(messages), REPLY)
    return got.select("conv_id", "turn", "at", "kind", "after_turn", "after_at", "level", "call_id", "linked", "valid", sha256(F.col("json")).alias("json_sha256"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store, version = shard(docs)
    return store.read(docs.schema, version).select("doc_id", "lang", "source", "n_chars", sha256(F.col("text")).alias("text_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_chat_format": op7_chat_format,
    "op8_multi_index": op8_multi_index,
    "op9_sharding": op9_sharding,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id <> c.keeper, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  -ln((('0x' || substr(md5('0:' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
    / (1.0 / (1.0 + 100.0 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS every, sum(weight) OVER () AS weights,
  coalesce(sum(3 * source_size) OVER o, 0) AS before, coalesce(sum(weight) OVER o, 0) AS gone FROM s
  WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (every - before)::DOUBLE / (weights - gone)::DOUBLE AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM c),
f AS (SELECT arg_min(level, n) FILTER (cap > weight * level) AS level FROM v),
p AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * f.level, cap::DOUBLE)) AS target FROM v, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN run - size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op7_chat_format": """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT * FROM m WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM m WHERE role = 'assistant'),
l AS (SELECT conv_id, max(turn) AS turn FROM c GROUP BY conv_id),
x AS (SELECT conv_id, turn, 0 AS place, 'message' AS kind, 0 AS after_at, 0 AS level, NULL AS call_id, NULL::BOOLEAN AS linked, NULL::BOOLEAN AS valid,
    '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' AS j FROM m
  UNION ALL SELECT c.conv_id, c.turn, 0, 'call', 0, 0, c.turn::VARCHAR, a.turn IS NOT NULL, c.text <> '',
    '{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":"' || c.turn || '","name":"reply","type":"call"}'
    FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
  UNION ALL SELECT conv_id, turn, -1, 'call', 0, 1, 'title', false, true, '{"arguments":{"last":' || turn || '},"id":"title","name":"title","type":"call"}' FROM l
  UNION ALL SELECT a.conv_id, a.turn, 0, 'result', 0, 0, (a.turn - 1)::VARCHAR, c.turn IS NOT NULL, NULL,
    '{"content":' || to_json(a.text) || ',"id":"' || (a.turn - 1) || '","of_turn":' || coalesce(c.turn::VARCHAR, 'null') || ',"type":"result"}'
    FROM a LEFT JOIN c ON a.conv_id = c.conv_id AND a.turn = c.turn + 1)
SELECT conv_id, turn, place AS "at", kind, turn AS after_turn, after_at, level, call_id, linked, valid, sha256(j) AS json_sha256 FROM x""",
    "op9_sharding": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}

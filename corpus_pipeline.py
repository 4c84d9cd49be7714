"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe import bpe_round_trip
from folioforge.llm.common import written
from folioforge.llm.line_dedup import line_dedup
from folioforge.llm.mixing import WORD, mix_sources
from folioforge.llm.ngram_join import ngram_join
from folioforge.llm.quality_rules import quality_rules
from folioforge.llm.queries import sha256, vocabulary_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines; ``n_chars`` follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates: five words, similarity 0.8."""
    return ngram_join(docs, width=5, percent=80, one_each=True).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with words as many times as the mix takes it; those not taken go."""
    taken = mix_sources(docs).where(F.col("text").rlike(WORD) & (F.col("copies") > 0))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of what they decode to."""
    coded = bpe_round_trip(docs, vocabulary_path())
    return coded.select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), sha256(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard_join", near), ("mixing", mix), ("bpe", encode)]

#: A suffix array, hash-ordered sampling and BPE have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

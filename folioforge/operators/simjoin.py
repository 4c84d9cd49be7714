"""Similarity joins on token sets: blocked by tokens, exact, without a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import GATE, casefold_trim, core_title, folded, normalize_distinct
from folioforge.shipping import ship


def with_tokens(rows: DataFrame, title: str, prefix: str = "") -> DataFrame:
    """Token columns of a title; the UDFs run once for each distinct title."""
    ship(rows.sparkSession)
    t = rows.select(F.col(title).alias("__t")).where(F.col(title).isNotNull()).distinct()
    core = core_title(F.col("__t"))
    t = t.select(
        "__t", folded(normalize_distinct("__t")).alias(f"{prefix}full"), folded(normalize_distinct(core)).alias(f"{prefix}core"),
        casefold_trim("__t").alias(f"{prefix}plain"), casefold_trim(core).alias(f"{prefix}core_plain"),
    )
    return rows.join(t, rows[title] == t["__t"], "left").drop("__t")


def _tokens(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(k, n, token): the distinct tokens of each row, without the array they come from."""
    t = F.array_distinct(F.col(tokens))
    return rows.where(F.size(tokens) > 0).select(F.col(key).alias("k"), F.size(t).alias("n"), F.explode(t).alias("token"))


def _prefix(each: DataFrame, often: DataFrame, threshold: float) -> DataFrame:
    """Enough of each row's rarest tokens that a match must share one."""
    place = F.row_number().over(Window.partitionBy("k").orderBy("often", "token"))
    need = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return each.join(often, "token", "left").withColumn("p", place).where(F.col("p") <= need).select("k", "n", "token")


def token_join(left: DataFrame, right: DataFrame, key_l: str, key_r: str, tokens: str, threshold: float = GATE) -> DataFrame:
    """(l, r, score) of pairs with shared / larger >= threshold; keys are unique in each side.

    The overlap is at least threshold times either size, so in one order of tokens (rarest
    first) a pair shares one of the first n - ceil(threshold n) + 1 of each side.  Only those
    meet; candidates of fitting sizes are then counted from the token arrays, joined once.
    """
    a, b = _tokens(left, key_l, tokens), _tokens(right, key_r, tokens)
    often = a.select("token").unionAll(b.select("token")).groupBy("token").agg(F.count("*").alias("often"))
    x, y = _prefix(a, often, threshold), _prefix(b, often, threshold).toDF("r", "m", "token")
    fits = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    pairs = x.join(y, "token").where(fits).select(F.col("k").alias("l"), "r").distinct()
    mine = left.select(F.col(key_l).alias("l"), F.array_distinct(F.col(tokens)).alias("t"))
    other = right.select(F.col(key_r).alias("r"), F.array_distinct(F.col(tokens)).alias("u"))
    score = F.size(F.array_intersect("t", "u")) / F.greatest(F.size("t"), F.size("u"))
    return pairs.join(mine, "l").join(other, "r").select("l", "r", score.alias("score")).where(F.col("score") >= threshold)


def title_join(left: DataFrame, right: DataFrame, key_l: str, key_r: str, threshold: float = GATE) -> DataFrame:
    """(l, r, score): the better of full titles and core titles, with exact equality where there are no tokens.

    Both sides come from ``with_tokens``.
    """
    parts = [token_join(left, right, key_l, key_r, c, threshold) for c in ("full", "core")]
    for tokens, plain in (("full", "plain"), ("core", "core_plain")):
        a = left.where(F.col(plain) != "").select(F.col(key_l).alias("l"), F.col(plain).alias("p"), F.size(tokens).alias("a"))
        b = right.where(F.col(plain) != "").select(F.col(key_r).alias("r"), F.col(plain).alias("p"), F.size(tokens).alias("b"))
        parts.append(a.join(b, "p").where((F.col("a") == 0) | (F.col("b") == 0)).select("l", "r", F.lit(1.0).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("l", "r").agg(F.max("score").alias("score"))


def tied(pairs: DataFrame) -> DataFrame:
    """All best-scoring right sides of each left side."""
    return pairs.withColumn("place", F.rank().over(Window.partitionBy("l").orderBy(F.desc("score")))).where("place = 1").drop("place")


def best(pairs: DataFrame) -> DataFrame:
    """The one best right side of each left side; none on a tie."""
    return tied(pairs).withColumn("n", F.count("*").over(Window.partitionBy("l"))).where("n = 1").drop("n")

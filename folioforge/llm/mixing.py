"""Operator 5: mix sources to target weights.

Method: Efraimidis-Spirakis sampling.  Each document draws the exponential key
``-ln(u) / weight``: u comes from the MD5 of its id, the weight from its quality.
A source's target is reached by complete epochs (all its documents, so many times)
and then by a fraction: documents in the order of their keys, prefix-summed until
the rest of the budget is used.

The order is made without a window over a whole source: keys fall into bins, bin
sums say in which bin a source's budget ends, and only that bin is cut into finer
bins and at last sorted and prefix-summed, equal rows as one group with their number.
A source that holds a third of all rows is thus pre-aggregated before any shuffle.

Defined results: a null text has size 0; a null source is a source of its own, the
last; a null id draws from its text; documents with equal keys are taken in the order
of id, then size; of equal rows as many are taken as come nearest to the target, any of
them; texts are counted whole; an empty table gives an empty table; result columns
replace input columns of the same name, in any case; other columns pass through under
any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Below so many sources their table is broadcast; beyond, it is joined by a shuffle that splits hot sources.
BROADCAST_SOURCES = 10_000
RESULT = ["size", "source_size", "target", "taken", "copies"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less for each symbol in 100 characters; never 0."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(1.0 / (1.0 + 100.0 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of an id, or of a text without one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(F.xxhash64(text).cast("string"), F.lit("")))))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight of all words, at most ``max_epochs`` times the size.

    A capped source's excess goes to the others by weight until none is above its
    cap; the sources that end capped are those of the smallest cap per weight.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = s.withColumn("level", rest / open_weight)
    first_open = F.first(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level")), ignorenulls=True).over(every)
    return level.withColumn("open_level", first_open).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("open_level"), F.col("cap").cast("double"))).alias("target"),
    )


def with_source(docs: DataFrame, per_source: DataFrame, rows: int) -> DataFrame:
    """Join a small per-source table: broadcast if it has few rows, else by shuffle."""
    right = per_source.withColumnRenamed("source", "__s")
    return docs.join(F.broadcast(right) if rows <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def low_bin(key: Column) -> Column:
    """The first of two bins of a key: a monotone map to [0, 1), cut."""
    return F.least(F.floor((1.0 - F.exp(-key)) * BINS), F.lit(BINS - 1)).cast("int")


def fine_bin(key: Column) -> Column:
    return F.floor((1.0 - F.exp(-key)) * (BINS * BINS)).cast("long")


class Mix:
    """The mix of the documents of (doc_id, source, text): written tables of one slim row a document and of a few rows a source."""

    def __init__(self, documents: DataFrame, weights: Sequence[int], max_epochs: int, seed: int, quality: Column | None):
        self.key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / (quality_weight(F.col("text")) if quality is None else quality)
        slim = documents.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("row"), size_of(F.col("text")).alias("size"), self.key.alias("key"))
        self.slim = C.written(slim, "sizes")
        sizes = C.written(self.slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
        self.n_sources = sizes.count()
        plan = source_targets(sizes, weights, max_epochs)
        plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        plan = C.written(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
        binned = self.slim.withColumns({"low": low_bin(F.col("key")), "fine": fine_bin(F.col("key"))})
        docs = with_source(binned, plan, self.n_sources)
        ends = C.written(self.end_bin(docs, "low", None), "ends")
        edge = C.written(with_source(docs, ends, self.n_sources).where(F.col("low") == F.col("end_low")), "edge")
        fines = C.written(self.end_bin(edge, "fine", "before_low"), "fine_ends")
        #: source_size, target, epochs, budget and the two end bins of each source
        self.plan = C.written(self.matched(self.matched(plan, ends), fines), "plans")
        last = with_source(edge, fines, self.n_sources).where(F.col("fine") == F.col("end_fine"))
        #: (doc_id, row, n, picked): of n equal rows in the bin where a budget ends, how many are picked
        self.edge = C.written(self.picks(last), "picks")

    @staticmethod
    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "__s")
        return left.join(right, left["source"].eqNullSafe(right["__s"]), "left").drop("__s")

    @staticmethod
    def end_bin(rows: DataFrame, bin_: str, base: str | None) -> DataFrame:
        """Each source's bin in which its budget ends, and the words in the bins before."""
        sums = rows.groupBy("source", bin_).agg(F.sum("size").alias("words"), F.max("budget").alias("budget"), F.max(base).alias("base") if base else F.lit(0).cast("long").alias("base"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy(bin_)) + F.col("base")
        return sums.withColumn("to", run).where(F.col("to") > F.col("budget")).groupBy("source").agg(
            F.min(bin_).alias(f"end_{bin_}"), F.min_by(F.col("to") - F.col("words"), bin_).alias(f"before_{bin_}")
        )

    @staticmethod
    def picks(last: DataFrame) -> DataFrame:
        """Prefix sums over the groups of equal rows of the last bin; the row in which the budget ends is picked if that comes nearer to the target."""
        groups = last.groupBy("source", "key", "doc_id", "size", "row").agg(F.count("*").alias("n"), F.max("budget").alias("budget"), F.max("before_fine").alias("before_fine"))
        order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = F.sum(F.col("n") * F.col("size")).over(order) + F.col("before_fine") - F.col("n") * F.col("size")
        room = F.col("budget") - before
        fits = F.when(F.col("size") == 0, F.when(room >= 0, F.col("n")).otherwise(F.lit(0))).otherwise(F.floor(room / F.col("size") + 0.5))
        return groups.withColumn("picked", F.least(F.col("n"), F.greatest(F.lit(0), fits)).cast("long")).select("doc_id", "row", "n", "picked")

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, source, row, key, anything else) with source_size, target and ``copies``, how often the mix takes each."""
        found = with_source(rows.withColumns({"__low": low_bin(F.col("key")), "__fine": fine_bin(F.col("key"))}), self.plan, self.n_sources)
        at_edge = F.coalesce((F.col("__low") == F.col("end_low")) & (F.col("__fine") == F.col("end_fine")), F.lit(False))
        whole = F.col("end_low").isNull() & (F.col("budget") > 0) | (F.col("__low") < F.col("end_low"))
        whole = whole | (F.col("__low") == F.col("end_low")) & (F.col("end_fine").isNull() | (F.col("__fine") < F.col("end_fine")))
        out = [*rows.columns, "source_size", "target", "copies"]
        inner = found.where(~at_edge).withColumn("copies", F.col("epochs") + F.coalesce(whole, F.lit(False)).cast("long")).select(*out)
        few = self.edge.withColumnsRenamed({"doc_id": "__id", "row": "__row"})
        edge = found.where(at_edge).join(few, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left")
        edge = edge.withColumns({"picked": F.coalesce("picked", F.lit(0)), "n": F.coalesce("n", F.lit(1))})
        sure = edge.where("picked = 0 or picked = n").withColumn("copies", F.col("epochs") + (F.col("picked") > 0).cast("long")).select(*out)
        # At most one group of equal rows a source is picked in part.
        some = C.written(edge.where("picked > 0 and picked < n").withColumn("__at", F.monotonically_increasing_id()), "parted")
        some = some.withColumn("__task", F.shiftright("__at", 33))
        per_task = some.groupBy("__id", "__row", "__task").agg(F.count("*").alias("__here"))
        group = Window.partitionBy("__id", "__row")
        per_task = per_task.withColumn("__before", F.sum("__here").over(group.orderBy("__task")) - F.col("__here")).withColumnsRenamed({"__id": "__id2", "__row": "__row2", "__task": "__task2"})
        numbered = some.join(per_task, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__row") == F.col("__row2")) & (F.col("__task") == F.col("__task2")))
        number = F.row_number().over(Window.partitionBy("__id", "__row", "__task").orderBy("__at")) + F.col("__before")
        parted = numbered.withColumn("copies", F.col("epochs") + (number <= F.col("picked")).cast("long")).select(*out)
        return inner.unionByName(sure).unionByName(parted)


def mix_sources(
    documents: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 0, quality: Column | None = None,
) -> DataFrame:
    """``documents`` with ``size`` (words), ``source_size``, ``target`` (the source's), ``taken`` (words, repeats counted) and ``copies`` (how often it is taken)."""
    cols = C.Carried(documents, RESULT)
    named = cols.frame.withColumnsRenamed({cols["doc_id"]: "doc_id", cols["source"]: "source", cols["text"]: "text"})
    mix = Mix(named, weights, max_epochs, seed, quality)
    rows = named.withColumns({"row": F.xxhash64("doc_id", "source", "text"), "key": mix.key})
    found = mix.copies(rows).withColumn("size", size_of(F.col("text"))).withColumn("taken", F.col("size") * F.col("copies"))
    return cols.named(found.withColumnsRenamed({"doc_id": cols["doc_id"], "source": cols["source"], "text": cols["text"]}), RESULT)


def mix_plan(
    documents: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 0, quality: Column | None = None,
) -> DataFrame:
    """(doc_id, source, and the results of ``mix_sources``) of all documents, from their sizes: texts are read once."""
    mix = Mix(documents.select("doc_id", "source", "text"), weights, max_epochs, seed, quality)
    return mix.copies(mix.slim).withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "source", *RESULT)

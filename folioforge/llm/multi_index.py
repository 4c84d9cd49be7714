"""Operator 8: approximate nearest neighbours by multi-index hashing.

Method: a rotation learned on a bounded sample (iterative quantisation) turns
vectors into binary codes.  Codes are cut into substrings, each with an index of its
own.  For a Hamming radius r, a code within r agrees with the query in some
substring up to its share of r (pigeonhole), so probing those neighbours of each
substring finds every code within r; floats then rerank what is found.

The radius is measured: for a bounded number of queries, the exact nearest vectors
among all rows give the distances that true neighbours have.  Queries that find
fewer than k rows within it go on with twice the radius, at last with all bits.

A row is indexed once a substring, under the key (substring, first bits of its
value); a query goes only to the keys that its probes touch.  So what is shuffled
grows with rows and queries where neighbours are near (clustered vectors); where they
are hardly nearer than others (random vectors), probes touch nearly all keys, as no
code tells rows apart, and queries meet all rows in blocks.  A key with many rows (a
vector that very many rows share) is split by row.

Defined results: vectors that are null, zero, of another length than most, or with
null or non-finite numbers take no part, nor do null ids; repeated rows (id and
vector) count once, and rows with the query's id are the query's own; of several
vectors of one id the nearest counts, for the nearest of the query's own; ties go to the
smaller id; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import common as C


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    some = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = some.where(~bad & F.exists("v", lambda x: x != 0.0)).dropDuplicates(["vec_id", "v"])
    return ok.withColumn("size", F.size("v"))


def learn(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations): each turn of up to ``dim`` bits is a rotation fitted to its own signs."""
    rng = np.random.default_rng(7)
    mean = sample.mean(0)
    z, dim, out = sample - mean, sample.shape[1], []
    left = bits
    while left > 0:
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        out.append(r[:, : min(left, dim)])
        left -= dim
    return mean, np.concatenate(out, 1)


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """(rows, substrings) codes of ``width`` bits each."""
    bits = (x - model[0]) @ model[1] > 0
    weights = 1 << np.arange(width, dtype=np.int64)
    return (bits.reshape(len(x), -1, width) * weights).sum(2)


def share(radius: int, parts: int) -> list[int]:
    """How far each substring is probed: if all were further off, the whole would be beyond the radius."""
    return [radius // parts if i <= radius % parts else radius // parts - 1 for i in range(parts)]


@functools.cache
def masks(width: int, distance: int) -> np.ndarray:
    """All ``width``-bit numbers with at most ``distance`` bits."""
    if distance >= width:
        return np.arange(1 << width, dtype=np.int64)
    return np.array([sum(1 << b for b in c) for d in range(distance + 1) for c in itertools.combinations(range(width), d)], np.int64)


def packed(parts: np.ndarray, width: int) -> np.ndarray:
    """The whole code of each row as one 64-bit number."""
    shift = np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(width)
    return np.bitwise_or.reduce(parts.astype(np.uint64) << shift, axis=1)


class Bucketed:
    """The rows of a key, in the order of their substring's value: the buckets of its index."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, part: int, width: int):
        value = substring(codes, part, width)
        order = np.lexsort((ids, value))
        self.ids, self.codes, self.x, value = ids[order], codes[order], x[order], value[order]
        self.norm = np.sqrt((self.x * self.x).sum(1))
        new = np.flatnonzero(np.diff(value, prepend=-1))
        self.values, self.start = value[new], np.append(new, len(value))
        self.part, self.width = part, width

    def touched(self, value: int, share: int) -> np.ndarray:
        """The buckets within the share of a value: by probes, or by those that exist where these are fewer."""
        probes = masks(self.width, share) if share < self.width // 4 else None
        if probes is not None and len(probes) < len(self.values):
            wanted = value ^ probes
            at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            return np.sort(at[self.values[at] == wanted])
        return np.flatnonzero(np.bitwise_count(self.values ^ value) <= share)

    def nearest(self, q_ids: np.ndarray, q_codes: np.ndarray, q: np.ndarray, radius: int, shares: list[int], k: int) -> Iterator[tuple]:
        """(query id, ids, scores, how many) of the k nearest of each query among rows within the radius that no earlier substring finds."""
        own = substring(q_codes, self.part, self.width)
        for i in np.argsort(own, kind="stable").tolist():
            hit = self.touched(int(own[i]), shares[self.part])
            if not len(hit):
                continue
            sizes = self.start[hit + 1] - self.start[hit]
            rows = np.repeat(self.start[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            differ = self.codes[rows] ^ q_codes[i]
            ok = (np.bitwise_count(differ) <= radius) & (self.ids[rows] != q_ids[i])
            for earlier in range(self.part):
                ok &= np.bitwise_count(substring(differ, earlier, self.width)) > shares[earlier]
            rows = rows[ok]
            if not len(rows):
                continue
            size = np.sqrt((q[i] * q[i]).sum())
            rough = (self.x[rows] @ q[i]) / self.norm[rows]
            if len(rows) > k:  # what may be among the nearest is scored the same way for every row
                rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * size]
            score = (self.x[rows] * q[i]).sum(1) / (self.norm[rows] * size)
            top = np.lexsort((self.ids[rows], -score))[:k]
            yield int(q_ids[i]), self.ids[rows][top], score[top], int(ok.sum())


def substring(codes: np.ndarray, part: int, width: int) -> np.ndarray:
    return ((codes >> np.uint64(part * width)) & np.uint64((1 << width) - 1)).astype(np.int64)


def exact_top(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For a bounded number of queries their k nearest of all rows: (query row, vector), by blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        qn = q / np.linalg.norm(q, axis=1, keepdims=True)
        best, kept = np.full((len(q), 0), 0.0), np.zeros((len(q), 0, q.shape[1]))
        for b in batches:
            x = matrix(b.column(1), q.shape[1])
            s = qn @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            s[ids[:, None] == b.column(0).to_numpy()[None, :]] = -9
            old = best.shape[1]
            s = np.concatenate([best, s], 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(s, top, 1)
            kept = np.stack([[kept[i][t] if t < old else x[t - old] for t in row] for i, row in enumerate(top)])
        for i in range(len(q) if best.shape[1] else 0):
            yield pa.RecordBatch.from_arrays([pa.array([i] * best.shape[1], pa.int32()), pa.array(best[i]), pa.array(list(kept[i]), pa.list_(pa.float64()))], names=["q", "s", "v"])

    C.prepared(vectors.sparkSession)
    rows = vectors.select("vec_id", "v").mapInArrow(run, "q int, s double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    got = rows.withColumn("r", rank).where((F.col("r") <= k) & (F.col("s") > -2)).toArrow()
    return got.column("q").to_numpy(), matrix(got.column("v").combine_chunks(), queries[1].shape[1])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def multi_index_search(
    vectors: DataFrame, every: int = 50, k: int = 5, parts: int = 4, width: int = 16, sample: int = 8192,
    measured: int = 256, aim: float = 0.98, key_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by cosine.

    Queries are the rows whose id is divisible by ``every``.  Codes have ``parts`` x
    ``width`` bits, at most 64.  ``sample`` rows fit the rotation, ``measured`` queries set
    the radius at which a share ``aim`` of their true neighbours is within reach.
    ``key_rows`` is about how many rows a key of the index has.
    """
    spark = C.prepared(vectors.sparkSession)
    good = clean(vectors)
    sizes = good.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, bits = sizes[0]["size"], parts * width
    good = C.written(good.where(F.col("size") == dim).select("vec_id", "v"), "vectors")
    by_hash = [F.xxhash64("vec_id"), F.col("vec_id")]
    fit_on = matrix(good.orderBy(*by_hash).limit(sample).toArrow().column("v").combine_chunks(), dim)
    model = learn(fit_on / np.linalg.norm(fit_on, axis=1, keepdims=True), bits)
    asked = good.where(F.col("vec_id") % every == 0)
    some = asked.orderBy(*by_hash).limit(measured).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    q = matrix(some.column("v").combine_chunks(), dim)
    at, near = exact_top(good, (some.column("vec_id").to_numpy(), q), k)
    radius = bits
    if len(at):
        a, b = (encode(x / np.linalg.norm(x, axis=1, keepdims=True), model, width) for x in (q[at], near))
        radius = int(np.quantile(np.bitwise_count(a ^ b).sum(1), aim, method="higher"))
    first_bits = min(width, max(0, (good.count() // key_rows).bit_length()))
    shared = spark.sparkContext.broadcast(model)

    def indexed(batch: pa.RecordBatch) -> Iterator[dict]:
        x = matrix(batch.column(1), dim)
        codes = packed(encode(x / np.linalg.norm(x, axis=1, keepdims=True), shared.value, width), width)
        for s in range(parts):
            yield {"part": np.full(len(x), s, np.int32), "bucket": substring(codes, s, width) >> (width - first_bits), "vec_id": batch.column(0), "code": C.longs(codes), "v": batch.column(1)}

    row = "part int, bucket long, vec_id long, code long, v array<double>"
    index = C.written(C.arrow_map(good, indexed, row), "index")
    # A table of at most parts * 2**width rows.
    blocks = index.groupBy("part", "bucket").agg(F.ceil(F.count("*") / F.lit(4 * key_rows)).cast("int").alias("blocks"))
    blocks = F.broadcast(C.written(blocks, "blocks"))
    rows = index.join(blocks, ["part", "bucket"]).select("part", "bucket", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "code", "v")
    open_ = index.where("part = 0").where(F.col("vec_id") % every == 0).select("vec_id", "code", "v")
    found = None
    while True:
        got = C.written(searched(rows, open_, blocks, radius, parts, width, first_bits, dim, k), "found")
        found = got if found is None else found.unionByName(got)
        if radius >= bits:
            break
        enough = got.groupBy("query_id").agg(F.sum("within").alias("within")).where(F.col("within") >= k).select(F.col("query_id").alias("vec_id"))
        open_ = C.written(open_.join(enough, "vec_id", "left_anti"), "open")
        if open_.isEmpty():
            break
        radius = min(bits, 2 * max(radius, 1))
    # Several vectors of one id: the nearest of them, for the nearest of the query's own.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(rows: DataFrame, asked: DataFrame, blocks: DataFrame, radius: int, parts: int, width: int, first_bits: int, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, within): each query's nearest k under each key, and once a query and key how many were within the radius."""
    shares = share(radius, parts)

    def routed(batch: pa.RecordBatch) -> Iterator[dict]:
        codes = batch.column(1).to_numpy().view(np.uint64)
        for s in range(parts):
            if shares[s] < 0:
                continue
            near = masks(first_bits, min(shares[s], first_bits))
            own = substring(codes, s, width) >> (width - first_bits)
            at = pa.array(np.repeat(np.arange(len(own)), len(near)))
            yield {"part": np.full(len(at), s, np.int32), "bucket": (own[:, None] ^ near).ravel(), "vec_id": batch.column(0).take(at), "code": batch.column(1).take(at), "v": batch.column(2).take(at)}

    sent = C.arrow_map(asked.select("vec_id", "code", "v"), routed, "part int, bucket long, vec_id long, code long, v array<double>")
    sent = sent.join(blocks, ["part", "bucket"]).select(
        "part", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "code", "v",
    )
    key = ["part", "bucket", "block"]
    both = rows.unionByName(sent).repartition(*key).sortWithinPartitions(*key, "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            ids, codes, x = batch.column(4).to_numpy(), batch.column(5).to_numpy().view(np.uint64), matrix(batch.column(6), dim)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
                if tuple(keys[lo, :3]) != now:
                    now, held, index = tuple(keys[lo, :3]), [], None
                if keys[lo, 3] == 0:
                    held.append((ids[lo:hi], codes[lo:hi], x[lo:hi]))
                    continue
                if not held:
                    continue
                if index is None:
                    index = Bucketed(*(np.concatenate(c) for c in zip(*held, strict=True)), int(now[0]), width)
                out += index.nearest(ids[lo:hi], codes[lo:hi], x[lo:hi], radius, shares, k)
            if out:
                sizes = [len(o[1]) for o in out]
                within = np.zeros(sum(sizes), np.int64)
                within[np.cumsum(sizes) - sizes] = [o[3] for o in out]
                columns = np.repeat([o[0] for o in out], sizes), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]), within
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score", "within"])

    return both.mapInArrow(run, "query_id long, vec_id long, score double, within long")

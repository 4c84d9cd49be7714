"""Operator 4: quality classifier by nearest-neighbour voting.

Method: texts become tf-idf vectors of hashed terms (letter trigrams, and word
shapes with what follows what), a truncated SVD of labelled texts gives latent
semantic vectors, and these labelled vectors are broadcast.  Every document's exact
cosines with all of them are computed in blocks; the labels of its nearest ones vote
with the weight of their similarity.

The model is fitted on at most ``sample`` labelled rows (those of the least hash of
their id), so what is collected and broadcast is bounded: ``sample`` vectors of
``terms`` counts once, then ``sample`` x ``rank`` and ``terms`` x ``rank`` numbers.
Scoring sees whole texts of all documents.

Defined results: null and empty texts, and all whose vector is zero, get the mean of
the fitted labels; of labelled vectors at one cosine (to 2**-18) those of the smallest
ids vote first; identical rows get identical scores; ids with several labels vote with
their mean; null labels and ids don't count; without any label every score is 0.5.
Very long texts are counted whole, in a block of their own.  An empty table gives an
empty table; result columns replace input columns of the same name, in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C
from folioforge.llm.textbytes import U64, blocks, mix, word_hashes, words

TRIGRAMS, SHAPES = 1024, 512
TERMS = TRIGRAMS + SHAPES
RESULT = ["held_out", "score", "predicted"]

_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b".,;:!?'\"()-")] = 4
_KIND[list(b"#*$%&|<>@/\\=+_~^{}[]`")] = 5
_KIND[128:] = 6


def terms(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The (documents, TERMS) counts of a block."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, TERMS), np.float32)
    if not len(buf):
        return out
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    if len(buf) > 2:
        b = buf.astype(np.uint32)
        gram = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(22)
        inside = doc[:-2] == doc[2:]
        flat = doc[:-2][inside] * TRIGRAMS + gram[inside]
        out[:, :TRIGRAMS] = np.bincount(flat, minlength=n_docs * TRIGRAMS).reshape(n_docs, TRIGRAMS)
    starts, ends, owner = words(buf, offsets)
    if not len(starts):
        return out
    kinds = np.zeros((7, len(buf) + 1), np.int32)
    for k in range(1, 7):
        np.cumsum(_KIND[buf] == k, out=kinds[k, 1:])
    size = ends - starts
    per = kinds[:, ends] - kinds[:, starts]
    case = np.where(per[1] + per[6] == 0, np.where(per[2] > 1, 2, 0), np.where(per[2] > 0, 1, 3))
    shape = case + 4 * (per[5] > 0) + 8 * (per[5] == size) + 16 * (per[3] > 0) + 32 * np.minimum(per[4], 2)
    h = word_hashes(buf, starts, ends)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    seen = np.zeros(len(h), np.int64)
    seen[order[1:]] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    lengths = np.minimum(np.log2(size).astype(np.int64), 5)
    one = (mix((shape * 64 + lengths * 4 + again * 2 + seen).astype(U64)) % U64(SHAPES // 2)).astype(np.int64)
    np.add.at(out, (owner, TRIGRAMS + one), 1)
    if len(h) > 1:
        next_ = owner[1:] == owner[:-1]
        two = (mix((shape[:-1] * 4096 + shape[1:] * 8 + again[1:] * 4 + again[:-1] * 2 + seen[1:]).astype(U64) + U64(99)) % U64(SHAPES // 2)).astype(np.int64)
        np.add.at(out, (owner[1:][next_], TRIGRAMS + SHAPES // 2 + two[next_]), 1)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf of counts; the trigrams and the shapes of a text have unit length each."""
    x = np.log1p(counts) * idf
    for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, TERMS)):
        x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-12)
    return x


def fit(counts: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idf, projection to latent vectors, the unit latent vectors of the rows)."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = weighted(counts, idf)
    _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    projection = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
    return idf, projection, unit(x @ projection)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(latent: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
    """Weighted vote of the nearest labelled vectors of each row; among equals the first vote, and a zero vector gets the mean label.

    Cosines are compared as rounded to 2**-18, so that the order of a sum's terms decides no tie.
    """
    k = min(neighbours, len(known))
    cosine = np.round((latent @ known.T) * np.float32(1 << 18)).astype(np.int64)
    place = (cosine << 32) - np.arange(len(known))  # one number to order by: cosine, then the first
    near = np.argpartition(-place, k - 1, axis=1)[:, :k]
    near.sort(axis=1)
    weight = np.exp(sharpness * (np.take_along_axis(cosine, near, 1) / (1 << 18) - 1))
    out = (weight * labels[near]).sum(1) / weight.sum(1)
    return np.where(latent.any(1), out, labels.mean())


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality_classifier(
    documents: DataFrame, labels: DataFrame, sample: int = 4000, rank: int = 64, neighbours: int = 25, sharpness: float = 20.0, threshold: float = 0.3,
) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` (likelihood of label 1) and ``predicted``.

    Rows with crc32(id as text) mod 5 = 0 are held out: their labels aren't learnt from.
    """
    spark = C.prepared(documents.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, buf, offsets in blocks(batch.column(2)):
            x = np.minimum(terms(buf, offsets), 65504).astype(np.float16)
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "quality": batch.column(1).slice(lo, hi - lo), "counts": pa.array([r.tobytes() for r in x], pa.binary())}

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = C.arrow_map(texts, count, f"doc_id {id_type}, quality double, counts binary")
    # Repeated ids: one row each, so no more than ``sample`` rows come to the driver.
    got = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("counts").alias("counts")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    model = None
    if len(order):
        raw = np.stack([np.frombuffer(x, np.float16) for x in got.column("counts").to_pylist()])[order].astype(np.float32)
        idf, projection, latent = fit(raw, rank)
        model = spark.sparkContext.broadcast((idf, projection, latent, got.column("quality").to_numpy()[order]))

    cols = C.Carried(documents, RESULT)
    where = cols.at("text")

    def score(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, buf, offsets in blocks(batch.column(where), 1 << 20):
            for a in range(0, hi - lo, 256):
                b = min(a + 256, hi - lo)
                part = offsets[a : b + 1]
                if model is None:
                    s = np.full(b - a, 0.5)
                else:
                    idf, projection, latent, values = model.value
                    x = weighted(terms(buf[part[0] : part[-1]], part - part[0]), idf)
                    s = votes(unit(x @ projection), latent, values, neighbours, sharpness)
                held = batch.column(len(cols.columns)).slice(lo + a, b - a)
                yield cols.batch(batch, lo + a, b - a) | {"held_out": held, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    source = cols.frame.withColumn("held", held_out(F.col(cols["doc_id"])))
    return cols.named(C.arrow_map(source, score, cols.schema("held_out boolean, score double, predicted int")), RESULT)

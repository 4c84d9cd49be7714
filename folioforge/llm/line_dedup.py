"""Operator 3: drop lines that repeat across documents.

Method: two Bloom filters, of line keys seen once and of keys seen twice, are
built in one pass; a second pass lets only suspected repeats (keys in the
twice-seen filter) be shuffled, where their exact text confirms the number of
documents and picks the one document that keeps the line.  A filter never misses
a repeat, so the result is exact at any fill; a fuller filter only shuffles more.

Defined results: a null text has one empty line and stays null; an empty text has
one empty line.  Rows with one ``doc_id`` count as one document, and null ids as
one document that comes before all others.  Identical rows get identical results.
Very long texts are blocks of their own; a document's own dropped places are one list.
An empty table gives an empty table.  Result columns replace input columns of the
same name, in any case; every other column passes through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm import common as C
from folioforge.llm.textbytes import IS_BLANK, LOWER, blocks, span_hashes

BLANKS = b" \t\n\v\f\r"
_LOWER = bytes(LOWER)
RESULT = ["n_lines", "n_dropped"]


def line_keys(buf: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's lines whose key has ``min_chars`` code points: hash, document, start and end of the key."""
    edge = offsets[:-1][np.diff(offsets) > 0]
    feeds = np.flatnonzero(buf == 10)
    starts = np.union1d(feeds + 1, edge)
    starts = starts[starts < len(buf)]
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1], ends[-1] = starts[1:], len(buf)
    solid = np.flatnonzero(~IS_BLANK[buf])
    if not len(solid) or not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    full = first <= last
    a, b = solid[first[full]], solid[last[full]] + 1
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    long = points[b] - points[a] >= min_chars
    a, b = a[long], b[long]
    return span_hashes(LOWER[buf], a, b), np.searchsorted(offsets, a, "right") - 1, a, b


def distinct_in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of the first line of each (document, hash)."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    keep = np.ones(len(h), bool)
    keep[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.sort(order[keep])


def twice_seen(texts: DataFrame, min_chars: int, log2_bits: int, probes: int) -> np.ndarray:
    """The Bloom filter of keys that two or more documents may hold."""
    chunk = 1 << 18

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((1 << log2_bits) >> 3, np.uint8) for _ in range(2))

        def put(bits: np.ndarray, h: np.ndarray) -> None:
            at = C.bloom_bits(h, log2_bits, probes).ravel()
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

        for batch in batches:
            for _, _, buf, offsets in blocks(batch.column(0)):
                h, doc, _, _ = line_keys(buf, offsets, min_chars)
                h, n = np.unique(h[distinct_in_doc(h, doc)], return_counts=True)
                put(twice, h[(n > 1) | C.bloom_has(once, h, log2_bits, probes)])
                put(once, h)
        yield from C.filter_chunks([once, twice], chunk)

    return C.merged_filters(texts.mapInArrow(partial, C.FILTER_SCHEMA), 2, log2_bits, chunk)[1]


def line_dedup(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, log2_bits: int = 27, probes: int = 4) -> DataFrame:
    """``documents`` with repeated lines dropped from ``text``, and ``n_lines`` (before) and ``n_dropped``.

    A key (the line without blanks at its ends, A-Z lower-cased) of ``min_chars``
    code points in ``min_docs`` documents loses all its lines but those of the
    largest ``doc_id`` that holds it.  ``log2_bits`` sets the fixed size of the two
    filters: 2**27 bits are 16 MB each, on the driver and in a worker.
    """
    spark = C.prepared(documents.sparkSession)
    cols = C.Carried(documents, RESULT)
    doc_id, text = cols["doc_id"], cols["text"]
    row = F.xxhash64(doc_id, text)
    slim = cols.frame.select(F.col(doc_id).alias("doc_id"), row.alias("row"), F.col(text).alias("text"))
    seen = twice_seen(slim.select("text"), min_chars, log2_bits, probes)
    shared = spark.sparkContext.broadcast(seen)

    def suspects(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, rows = batch.column(0), batch.column(1)
        for lo, _, buf, offsets in blocks(batch.column(2)):
            h, doc, a, b = line_keys(buf, offsets, min_chars)
            hit = np.flatnonzero(C.bloom_has(shared.value, h, log2_bits, probes))
            if not len(hit):
                continue
            low = LOWER[buf]
            keys = [low[x:y].tobytes() for x, y in zip(a[hit], b[hit], strict=True)]
            first = list(dict(zip(zip(doc[hit].tolist(), keys, strict=True), range(len(hit)), strict=True)).values())  # a key once a document
            hit, keys = hit[first], [keys[i].decode() for i in first]
            at = pa.array(doc[hit] + lo)
            yield {"doc_id": ids.take(at), "row": rows.take(at), "at": (a[hit] - offsets[doc[hit]]), "key": keys}

    id_type = T.StructField("doc_id", slim.schema["doc_id"].dataType)
    schema = T.StructType([id_type, *T.StructType.fromDDL("row long, at long, key string")])
    found = C.written(C.arrow_map(slim, suspects, schema), "suspects")
    kept = found.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
    kept = C.written(kept.where(F.col("docs") >= min_docs).select("key", "keeper"), "confirmed")
    drops = (
        found.join(kept, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("id"), F.col("row").alias("row")).agg(F.collect_set("at").alias("drops"))
    )
    joined = cols.frame.withColumn("hash", row).join(drops, F.col(doc_id).eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row")), "left")
    where = cols.at("text")

    def rebuild(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, drops = batch.column(where).cast(pa.binary()).to_pylist(), batch.column(len(cols.columns)).to_pylist()
        new, n_lines, n_dropped = [], [], []
        for text, at in zip(texts, drops, strict=True):
            n_lines.append((text or b"").count(b"\n") + 1)
            n_dropped.append(0)
            if at:
                lines = text.split(b"\n")
                keys = [x.strip(BLANKS).translate(_LOWER) for x in lines]
                begins = np.cumsum([0] + [len(x) + 1 for x in lines])
                gone = {keys[i] for i in np.searchsorted(begins, at, "right") - 1}
                text = b"\n".join(x for x, k in zip(lines, keys, strict=True) if k not in gone)
                n_dropped[-1] = sum(k in gone for k in keys)
            new.append(text)
        yield cols.batch(batch) | {cols.columns[where]: pa.array(new, pa.binary()).cast(pa.string()), "n_lines": n_lines, "n_dropped": n_dropped}

    return cols.named(C.arrow_map(joined.select(*cols.columns, "drops"), rebuild, cols.schema("n_lines long, n_dropped long")), RESULT)

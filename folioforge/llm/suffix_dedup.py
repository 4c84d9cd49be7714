"""Operator 10: remove byte strings that occur anywhere else.

Method: a suffix sort by mergesort whose comparisons take logarithmic time: prefix
polynomial hashes and binary search give the common extension of two suffixes, and
the bytes themselves verify it.

Only suffixes that can matter are sorted.  Each 200-byte window of a text has an
anchor, the least hash among its runs of 64 bytes, so equal windows have equal
anchors at equal places.  Consecutive windows with one anchor are a context.

1. Anchors seen twice: two Bloom filters (once seen, twice seen) in one pass.
2. A second pass lets only contexts with such an anchor go on.  Contexts that are
   equal as a whole (128-bit digest) repeat in all their windows; they are counted by
   a plain aggregation, so copies by the million are pre-aggregated.
3. One of each set of equal contexts meets the different contexts of its anchor, and
   their suffixes are sorted.  Of an anchor with over ``hot`` different contexts the
   windows are counted by 128-bit digest, a plain aggregation again; those found once
   name their contexts, and the others repeat.
4. Spans go back to their documents; their union is removed.

Defined results: null and empty texts have no bytes; texts below the length lose
nothing; what is kept may break inside a character, so ``kept`` is binary.
Identical rows are copies of each other, and lose what they share wholly, first and
last alike.  A very long text is taken in overlapping pieces.  An empty table gives an
empty table; result columns replace input columns of the same name, in any case; other
columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C
from folioforge.llm.textbytes import U64, PrefixHash, blocks, gram_hashes

RESULT = ["kept", "n_bytes", "n_removed", "n_spans"]
CHUNK_BYTES = 1 << 20
#: A longer text is taken in pieces of so many windows; a context that a cut parts is two contexts.
PIECE = 4 << 20
_HIGH, _LOW = U64(0xFFFFFFFF00000000), U64(0x00000000FFFFFFFF)


def gram_width(length: int) -> int:
    """The width of anchors, about a third of the length, as gram_hashes has it."""
    about = max(1, length * 64 // 200)
    return about if about < 8 else 8 << (about // 8).bit_length() - 1


def pieces(column, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes cut off before, bytes, offsets) of blocks of texts; pieces of one text overlap by ``length`` - 1 bytes."""
    for lo, _, buf, offsets in blocks(column):
        for at in range(0, max(len(buf), 1), PIECE) if len(offsets) == 2 else [0]:
            part = buf[at : at + PIECE + length - 1] if len(offsets) == 2 else buf
            yield lo, at, part, np.array([0, len(part)]) if len(offsets) == 2 else offsets


def contexts(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block's contexts: anchor hash, anchor position, first and last window start, document."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none.view(U64), none, none, none, none
    h = gram_hashes(buf, gram)
    w = length - gram + 1
    keys = (h & _HIGH) | np.arange(len(h), dtype=U64)
    rows = -(-len(keys) // w) + 1
    padded = np.full(rows * w, np.iinfo(np.uint64).max, U64)
    padded[: len(keys)] = keys
    table = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(buf) - length + 1
    anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _LOW).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each document
    inside = np.zeros(n + 1, np.int64)
    full = np.flatnonzero(sizes)
    np.add.at(inside, offsets[full], 1)
    np.add.at(inside, offsets[full] + sizes[full], -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    change[offsets[full]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    first, last = first[inside[first]], last[inside[first]]
    return h[anchor[first]], anchor[first], first, last, np.searchsorted(offsets, first, "right") - 1


class SuffixSort:
    """Sorted order and common extensions of suffixes of contexts in one buffer."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.hash = buf, PrefixHash(buf)

    def extension(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many bytes from a and b on are equal, at most ``room``, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), room.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            same = self.hash(x, x + mid) == self.hash(y, y + mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1

    def less(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; a suffix that ends first comes first."""
        room = np.minimum(a_end - a, b_end - b)
        n = self.extension(a, b, room)
        ended = n == room
        out = (a_end - a) < (b_end - b)
        go = ~ended
        out[go] = self.buf[a[go] + n[go]] < self.buf[b[go] + n[go]]
        return out

    def order(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mergesort, all merges of a level at once: an element's place is its place in its own run and in the other."""
        n = len(at)
        order, width = np.arange(n), 1
        while width < n:
            pos = np.arange(n)
            run = pos // width
            right = run % 2 == 1
            base = run // 2 * 2 * width
            low = np.where(right, base, np.minimum(base + width, n))
            start = low.copy()
            high = np.where(right, base + width, np.minimum(base + 2 * width, n))
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                own, other, r = order[open_], order[mid], right[open_]
                # left elements go before equal right ones
                before = np.where(r, ~self.less(at[own], end[own], at[other], end[other]), self.less(at[other], end[other], at[own], end[own]))
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            place = base + (pos - base - np.where(right, width, 0)) + (low - start)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, 2 * width
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` or, after a hash collision, what the bytes say."""
        out = n.copy()
        for k in range(0, len(a), 4096):
            x, y, m = a[k : k + 4096], b[k : k + 4096], n[k : k + 4096]
            step = np.arange(int(m.max(initial=0)))
            inside = step[None, :] < m[:, None]
            ix, iy = np.where(inside, x[:, None] + step, 0), np.where(inside, y[:, None] + step, 0)
            wrong = inside & (self.buf[ix] != self.buf[iy])
            hit = wrong.any(1)
            out[k : k + 4096][hit] = wrong[hit].argmax(1)
        return out


def repeated_windows(buf: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which window starts of a buffer of contexts hold a string that starts at another window, too."""
    sort = SuffixSort(buf)
    sizes = np.diff(bounds) - length + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[:-1][owner]
    end = bounds[1:][owner]
    h = sort.hash(at, at + length)
    by_hash = np.argsort(h, kind="stable")
    same = h[by_hash][1:] == h[by_hash][:-1]
    partner = np.full(len(at), -1)
    partner[by_hash[:-1][same]] = by_hash[1:][same]
    back = np.full(len(at), -1)
    back[by_hash[1:][same]] = by_hash[:-1][same]
    partner = np.where(partner >= 0, partner, back)
    open_ = partner >= 0  # a window without an equal hash isn't repeated
    found = np.zeros(len(at), bool)
    while open_.any():
        heads = open_.copy()
        heads[1:] &= ~(open_[:-1] & (owner[1:] == owner[:-1]))
        heads = np.flatnonzero(heads)
        chosen = np.unique(np.concatenate([heads, partner[heads]]))
        ranked = chosen[sort.order(at[chosen], end[chosen])]
        a, b = ranked[:-1], ranked[1:]
        n = sort.extension(at[a], at[b], np.minimum(end[a] - at[a], end[b] - at[b]))
        n = sort.verified(at[a], at[b], n)
        reach = np.zeros(len(at), np.int64)
        np.maximum.at(reach, a, n)
        np.maximum.at(reach, b, n)
        got = reach[heads] - length + 1
        for head, more in zip(heads.tolist(), got.tolist(), strict=True):
            if more > 0:
                found[head : head + more] = True
                open_[head : head + more] = False
            else:  # a hash collision: look at the bytes of all windows of this hash
                text = buf[at[head] : at[head] + length]
                found[head] = any(np.array_equal(text, buf[at[i] : at[i] + length]) for i in np.flatnonzero(h == h[head]) if i != head)
                open_[head] = False
    return found


def suffix_dedup(documents: DataFrame, length: int = 200, log2_bits: int = 27, probes: int = 4, hot: int = 512) -> DataFrame:
    """``documents`` with ``kept`` (the bytes left, binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Each byte goes that is covered by a string of ``length`` bytes that also starts
    anywhere else.  ``log2_bits`` sets the fixed size of the filters.
    """
    spark = C.prepared(documents.sparkSession)
    gram = gram_width(length)
    chunk = 1 << 18

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((1 << log2_bits) >> 3, np.uint8) for _ in range(2))

        def put(bits: np.ndarray, h: np.ndarray) -> None:
            at = C.bloom_bits(h, log2_bits, probes).ravel()
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

        for batch in batches:
            for _, _, buf, offsets in pieces(batch.column(0), length):
                h, n = np.unique(contexts(buf, offsets, length, gram)[0], return_counts=True)
                put(twice, h[(n > 1) | C.bloom_has(once, h, log2_bits, probes)])
                put(once, h)
        yield from C.filter_chunks([once, twice], chunk)

    cols = C.Carried(documents, RESULT)
    row = F.xxhash64(cols["doc_id"], cols["text"])
    texts = cols.frame.select(row.alias("row"), F.col(cols["text"]).alias("text"))
    twice = C.merged_filters(texts.select("text").mapInArrow(count_anchors, C.FILTER_SCHEMA), 2, log2_bits, chunk)[1]
    shared = spark.sparkContext.broadcast(twice)

    def suspects(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = batch.column(0).to_numpy()
        for lo, cut_off, buf, offsets in pieces(batch.column(1), length):
            h, anchor, first, last, doc = contexts(buf, offsets, length, gram)
            hit = np.flatnonzero(C.bloom_has(shared.value, h, log2_bits, probes))
            if not len(hit):
                continue
            h, anchor, first, last, doc = (x[hit] for x in (h, anchor, first, last, doc))
            texts = [buf[a : b + length].tobytes() for a, b in zip(first, last, strict=True)]
            digests = [xxhash.xxh3_128_digest(t, seed=r) for t, r in zip(texts, (anchor - first).tolist(), strict=True)]
            yield {
                "row": rows[doc + lo], "h": C.longs(h), "c": pa.array(digests, pa.binary()),
                "first": first - offsets[doc] + cut_off, "windows": (last - first + 1).astype(np.int32), "context": pa.array(texts, pa.binary()),
            }

    found = C.written(C.arrow_map(texts, suspects, "row long, h long, c binary, first long, windows int, context binary"), "contexts")
    equal = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("rep"), F.max("windows").alias("windows"))
    equal = C.written(equal, "equal_contexts")
    whole = equal.where("n > 1").select("c", F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi"))
    several = equal.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    reps = C.written(equal.join(several, "h").select("h", F.col("rep.row").alias("row"), F.col("rep.first").alias("first"), "different"), "representatives")
    to_sort = found.select("row", "first", "h", "c", "context").join(reps, ["row", "first", "h"])
    to_sort = C.written(to_sort.select("h", "c", "context", "different"), "to_sort")

    def windows(batch: pa.RecordBatch) -> Iterator[dict]:
        for c, context in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            n = len(context) - length + 1
            # the last row is the context's own: minus its number of windows
            digests = b"".join([*(xxhash.xxh3_128_digest(context[k : k + length]) for k in range(n)), c])
            w, own = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2), np.frombuffer(c, ">i8").astype(np.int64)
            lo = np.append(np.arange(n, dtype=np.int32), np.int32(-n))
            yield {"own": lo < 0, "w1": w[:, 0], "w2": w[:, 1], "c1": np.repeat(own[0], n + 1), "c2": np.repeat(own[1], n + 1), "lo": lo}

    def repeated(batch: pa.RecordBatch) -> Iterator[dict]:
        c, lo, hi = [], [], []
        for c1, c2, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            flags = np.zeros(-min(found) + 2, bool)
            flags[1:-1] = True
            flags[[x + 1 for x in found if x >= 0]] = False
            for x, y in np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2).tolist():
                c.append(np.array([c1, c2], ">i8").tobytes())
                lo.append(x)
                hi.append(y - 1)
        yield {"c": pa.array(c, pa.binary()), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())}

    # Windows of crowded anchors are counted by digest: no task gathers the rows of one.  What is
    # found once tells its context by itself, so a context's repeated windows are the others.
    crowded = to_sort.where(F.col("different") > hot).select("c", "context").dropDuplicates(["c"])
    each = C.arrow_map(crowded, windows, "own boolean, w1 long, w2 long, c1 long, c2 long, lo int")
    once = each.groupBy("own", "w1", "w2").agg(F.count("*").alias("n"), *(F.min(x).alias(x) for x in ("c1", "c2", "lo"))).where("n = 1")
    counted = C.arrow_map(once.groupBy("c1", "c2").agg(F.collect_list("lo").alias("found")), repeated, "c binary, lo int, hi int")
    placed = to_sort.where(F.col("different") <= hot).select("h", "c", "context").repartition("h").sortWithinPartitions("h", "c")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size, now, before = [], [], 0, None, None

        def out(rows: list) -> pa.RecordBatch:
            data = [np.frombuffer(r[1], np.uint8) for r in rows]
            bounds = np.cumsum([0, *map(len, data)])
            flags = repeated_windows(np.concatenate(data), bounds, length)
            c, lo, hi = [], [], []
            at = 0
            for (digest, _), text in zip(rows, data, strict=True):
                n = len(text) - length + 1
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flags[at : at + n], [False]]).astype(np.int8))).reshape(-1, 2)
                for x, y in edge.tolist():
                    c.append(digest)
                    lo.append(x)
                    hi.append(y - 1)
                at += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["c", "lo", "hi"])

        for batch in batches:
            for h, c, context in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h != now:
                    held += group if len(group) > 1 else []
                    now, group, before = h, [], None
                    if size > CHUNK_BYTES:
                        if held:
                            yield out(held)
                        held, size = [], 0
                if c == before:
                    continue  # the context of an identical row
                before = c
                group.append((c, context))
                size += len(context)
        held += group if len(group) > 1 else []
        if held:
            yield out(held)

    C.prepared(spark)
    partial = placed.mapInArrow(sort, "c binary, lo int, hi int")
    runs = C.written(whole.unionByName(partial.unionByName(counted).join(whole.select("c"), "c", "left_anti")), "runs")
    spans = found.select("row", "first", "c").join(runs, "c").groupBy("row").agg(
        F.collect_set(F.struct((F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") + length).alias("end"))).alias("spans")
    )
    spans = spans.withColumnRenamed("row", "key")
    joined = cols.frame.withColumn("hash", row).join(spans, F.col("hash") == F.col("key"), "left")
    where = cols.at("text")

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for text, spans in zip(batch.column(where).cast(pa.binary()).to_pylist(), batch.column(len(cols.columns)).to_pylist(), strict=True):
            text = text or b""
            left, at, runs = [], 0, 0
            for x, y in sorted((s["start"], s["end"]) for s in spans or ()):
                if x > at or not runs:
                    left.append(text[at:x])
                    runs += 1
                    at = x
                at = max(at, y)
            left.append(text[at:])
            kept.append(b"".join(left))
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept[-1]))
            n_spans.append(runs)
        yield cols.batch(batch) | {"kept": pa.array(kept, pa.binary()), "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans}

    results = "kept binary, n_bytes long, n_removed long, n_spans long"
    return cols.named(C.arrow_map(joined.select(*cols.columns, "spans"), cut, cols.schema(results)), RESULT)

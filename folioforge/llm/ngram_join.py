"""Operator 6: n-gram Jaccard join and its components.

Method: vertical partitioning.  All n-grams have one global order, from rare to
frequent (by a fixed-size sketch of document frequencies over the whole table, then
by hash; any total order is right, a good one is fast).  The order is cut into
fragments, a document's set into one segment a fragment; overlaps are counted
segment by segment, and the counts summed for each pair.

1. Equal sets collapse to one set; links are sought between different sets only.
2. Two sets with the asked similarity share an n-gram among the first of each in
   the order (prefix filter), so sets meet at such n-grams.
3. Sets that meet are compared by their parities: a set's n-grams fall into bins, and
   a bit says whether a bin holds an odd number.  Bits that differ bound the symmetric
   difference from below and nearly reach it, so few unlinked pairs pass, and sets
   that met by chance go on nowhere.  At each shared n-gram one set leads; what is
   near it is counted first, and the links make components.  Only sets of different
   components are paired after that, by longer parities.  An n-gram at which very many sets meet is split
   into pairs of blocks of its sets, each a key of its own.
4. Every pair that passes is counted exactly, fragment by fragment.
5. Components by repeated minimum labels with pointer jumping.

Nothing is capped: the bound in 3 drops only pairs that can't be linked.

A set is known by a 64-bit number; a second one tells if two sets have the same, and
then these are numbered anew, so sets are equal if 128 bits are.

Defined results: words are runs of non-blank characters with A-Z lower-cased; a
text of fewer words than ``width`` is one n-gram; a text without words (null, empty,
blank) has no n-grams, is linked with nothing and is its own component.  Repeated
rows link with each other.  A null id is in the component of its links, null if it
has none with an id.  A very long text is hashed as a whole, in a block of its own.
Ties in the order of n-grams go into the prefix together.  An empty table gives an
empty table; result columns replace input columns of the same name, in any case;
other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioforge.llm import common as C
from folioforge.llm.textbytes import U64, blocks, flat, mix, shingle_sets

#: Counters of the sketch that travel in one row.
CHUNK = 1 << 16
#: Sets with one number and different second ones that may be numbered anew (about 100 are expected in 5e10 sets).
MOST_RENUMBERED = 100_000
#: Bins of the two parities of a set, coarse and fine: about so many for each n-gram in which linked sets may
#: differ, a power of two within the bounds.
COARSE, FINE = (6, 64, 4096), (48, 512, 1 << 15)
#: Pairs that are compared at a time.
PAIRS = 1 << 17
RESULT = ["n_shingles", "component_id"]


def max_difference(n_a, n_b, percent: int):
    """The largest symmetric difference of linked sets: 100 |A & B| >= percent |A | B|."""
    return (100 - percent) * (n_a + n_b) // (100 + percent)


def numbered(h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each set, from its n-gram hashes (sets are runs of ``h``)."""
    return tuple(mix(np.add.reduceat(mix(h + U64(seed)), begin) + n.astype(U64)) for seed in (0x51ED270B, 0x7C3A9E15B4D26F81))


class Shingles:
    """The sets of a block's documents: hashes, and of each non-empty set its document, begin, size and number."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, width: int, renumbered: np.ndarray):
        self.h, self.owner = shingle_sets(buf, offsets, width)
        self.per_doc = np.bincount(self.owner, minlength=len(offsets) - 1)
        self.doc = np.flatnonzero(self.per_doc)
        self.n = self.per_doc[self.doc]
        self.begin = np.searchsorted(self.owner, self.doc)
        self.ids, self.check = numbered(self.h, self.begin, self.n) if len(self.doc) else (np.zeros(0, U64), np.zeros(0, U64))
        if len(renumbered):
            self.ids = np.where(np.isin(self.ids, renumbered), self.check, self.ids)


def parities(sets: Shingles, percent: int, bins: tuple[int, int, int]) -> list[bytes]:
    """Each set's bits: bin i (the low bits of a hash) holds an odd number of n-grams."""
    each, least, most = bins
    wanted = each * np.maximum(max_difference(sets.n, sets.n, percent), 1)
    bins = np.clip(1 << np.round(np.log2(wanted)).astype(np.int64), least, most)
    start = np.cumsum(bins) - bins
    at = np.repeat(start, sets.n) + (sets.h & np.repeat(bins - 1, sets.n).astype(U64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(bins.sum())) & 1).astype(np.uint8), bitorder="little")
    return [odd[a : a + b].tobytes() for a, b in zip((start // 8).tolist(), (bins // 8).tolist(), strict=True)]


def set_rows(documents: DataFrame, width: int, percent: int, sketch_bits: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """A row for each document, (doc_id, row, n, set, parity, fine); the sketch of document frequencies; the renumbered sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << sketch_bits, np.uint32)
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column(2)):
                sets = Shingles(buf, offsets, width, np.zeros(0, U64))
                np.add.at(sketch, (sets.h >> U64(64 - sketch_bits)).astype(np.int64), np.uint32(1))
                ids, check = np.zeros((2, hi - lo), U64)
                ids[sets.doc], check[sets.doc] = sets.ids, sets.check
                both_parities = [[None] * (hi - lo) for _ in (COARSE, FINE)]
                for column, bins in zip(both_parities, (COARSE, FINE), strict=True):
                    for d, x in zip(sets.doc.tolist(), parities(sets, percent, bins), strict=True):
                        column[d] = x
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sets.per_doc, pa.int64()), pa.array(C.longs(ids)),
                    pa.array(C.longs(check)), *(pa.array(x, pa.binary()) for x in both_parities), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary()),
                ], names=names)
        sketch = np.minimum(sketch, 65535).astype(np.uint16)  # an order needs no more of what one task saw
        for k in range(0, len(sketch), CHUNK):
            if sketch[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, id_arrow), *(pa.nulls(1, pa.int64()) for _ in range(4)), *(pa.nulls(1, pa.binary()) for _ in range(2)),
                    pa.array([k // CHUNK], pa.int32()), pa.array([C.packed(sketch[k : k + CHUNK])], pa.binary()),
                ], names=names)

    id_type = documents.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("row long, n long, set long, check long, parity binary, fine binary, chunk int, counts binary")])
    names = schema.names
    C.prepared(documents.sparkSession)
    both = C.written(documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, schema), "sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(C.unpacked(x).tobytes(), np.uint16).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([C.packed(x)], pa.binary())], names=["chunk", "counts"])

    sketch = np.zeros(1 << sketch_bits, np.int64)
    chunks = both.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(add, "chunk int, counts binary")
    for r in chunks.toLocalIterator():
        x = np.frombuffer(C.unpacked(r["counts"]).tobytes(), np.int64)
        sketch[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(x)] = x
    rows = both.where("chunk is null").drop("chunk", "counts")
    shared = rows.where("n > 0").groupBy("set").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("set")
    again = [r["set"] for r in shared.limit(MOST_RENUMBERED + 1).collect()]
    if len(again) > MOST_RENUMBERED:
        raise RuntimeError(f"over {MOST_RENUMBERED} sets share their number")
    if again:
        rows = rows.withColumn("set", F.when(F.col("set").isin(again), F.col("check")).otherwise(F.col("set")))
    return rows.drop("check"), np.minimum(sketch, (1 << 32) - 1).astype(np.uint32), np.array(again, np.int64).view(U64)


def order_keys(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The place of n-grams in the global order: frequency in the sketch, then hash."""
    bits = int(len(sketch)).bit_length() - 1
    often = np.minimum(sketch[(h >> U64(64 - bits)).astype(np.int64)], (1 << 24) - 1).astype(U64)
    return (often << U64(40)) | (h >> U64(24))


def pivots(sketch: np.ndarray, fragments: int) -> np.ndarray:
    """Frequencies that cut the global order into fragments of about as many n-grams."""
    order = np.argsort(sketch, kind="stable")
    mass = np.cumsum(sketch[order], dtype=np.int64)
    if not mass[-1]:
        return np.zeros(0, U64)
    at = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)
    often = np.minimum(sketch[order[at]], (1 << 24) - 1).astype(U64)
    return (often << U64(40)) | ((order[at].astype(U64) << U64(64 - (int(len(sketch)).bit_length() - 1))) >> U64(24))


def prefix_rows(documents: DataFrame, width: int, percent: int, sketch, renumbered: np.ndarray) -> DataFrame:
    """(token, set, n): the n-grams of each set at which a linked set must be met."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, buf, offsets in blocks(batch.column(0)):
            sets = Shingles(buf, offsets, width, renumbered)
            if not len(sets.h):
                continue
            keys = order_keys(sets.h, sketch.value)
            sizes = sets.n - -(-percent * sets.n // 100) + 1
            out_h = []
            for i, (b, n, first) in enumerate(zip(sets.begin.tolist(), sets.n.tolist(), sizes.tolist(), strict=True)):
                own, k = sets.h[b : b + n], keys[b : b + n]
                own = own[k <= np.partition(k, first - 1)[first - 1]]  # equal places count as one
                sizes[i] = len(own)
                out_h.append(own)
            yield {"token": C.longs(np.concatenate(out_h)), "set": C.longs(np.repeat(sets.ids, sizes)), "n": np.repeat(sets.n, sizes).astype(np.int32)}

    return C.arrow_map(documents.select("text"), run, "token long, set long, n int")


class Met:
    """Rows of sets under keys (token, low, high), sorted by key: columns, and the words of their parities."""

    def __init__(self, key: np.ndarray, set_: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, words: np.ndarray, start: np.ndarray):
        self.key, self.set, self.n, self.label, self.side, self.words, self.start = key, set_, n, label, side, words, start

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Met:
        data, offsets = flat(batch.column("parity"))
        words = data[offsets[0] : offsets[-1]].copy().view(np.uint64)
        key = np.stack([batch.column(x).to_numpy() for x in ("token", "low", "high")], 1)
        return cls(key, *(batch.column(x).to_numpy().astype(np.int64) for x in ("set", "n", "label", "side")), words, (offsets - offsets[0]) // 8)

    def __len__(self) -> int:
        return len(self.set)

    def slice(self, lo: int, hi: int) -> Met:
        start = self.start[lo : hi + 1]
        cols = (x[lo:hi] for x in (self.key, self.set, self.n, self.label, self.side))
        return Met(*cols, self.words[start[0] : start[-1]], start - start[0])

    def after(self, other: Met) -> Met:
        cols = (np.concatenate([x, y]) for x, y in zip((other.key, other.set, other.n, other.label, other.side, other.words), (self.key, self.set, self.n, self.label, self.side, self.words), strict=True))
        return Met(*cols, np.concatenate([other.start, self.start[1:] + other.start[-1]]))

    def cuts(self) -> np.ndarray:
        """The begins of the runs of rows of one key, and the end."""
        return np.concatenate([[0], np.flatnonzero((self.key[1:] != self.key[:-1]).any(1)) + 1, [len(self)]])

    def bits(self, rows: np.ndarray, bins: int) -> np.ndarray:
        """The parities of rows that all have so many words, folded to ``bins`` words."""
        size = int(self.start[rows[0] + 1] - self.start[rows[0]])
        x = self.words[self.start[rows][:, None] + np.arange(size)]
        while x.shape[1] > bins:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        return x

    def close(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets of rows x and y may be linked, by sizes and parities."""
        most = max_difference(self.n[x], self.n[y], percent)
        ok = np.abs(self.n[x] - self.n[y]) <= most
        size = np.diff(self.start)
        go = np.flatnonzero(ok)
        kinds = size[x[go]] * (FINE[2] + 1) + size[y[go]]
        for kind in np.unique(kinds):
            at = go[kinds == kind]
            bins = int(min(size[x[at[0]]], size[y[at[0]]]))
            differ = np.bitwise_count(self.bits(x[at], bins) ^ self.bits(y[at], bins)).sum(1, dtype=np.int64)
            ok[at] = differ <= most[at]
        return ok


def survey(rows: DataFrame, percent: int) -> DataFrame:
    """(token, a, b): pairs of a token's leader a with the sets b near it, and with null b the sets near any set of their key.

    A key's leader is its first row; keys whose ``label`` is 0 have none that counts.
    Rows come sorted by key and place; a key's rows are few (see ``dealt``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in keywise(batches):
            cuts = met.cuts()
            size = np.diff(cuts)
            lead = np.repeat(cuts[:-1], size)
            near = np.zeros(len(met), bool)
            other = np.flatnonzero(met.set != met.set[lead])
            for lo in range(0, len(other), PAIRS):
                y = other[lo : lo + PAIRS]
                near[y] = met.close(lead[y], y, percent)
            led = np.flatnonzero(near & (met.label == 1))
            yield out(met.key[led, 0], met.set[lead[led]], met.set[led], True)
            # The rest may be near others than the leader.
            apart = other[~near[other]]
            near[lead[near]] = True
            each = np.repeat(size, size)[apart]
            before = np.cumsum(each) - each
            for lo in range(0, int(each.sum()), PAIRS):
                k = np.arange(lo, min(lo + PAIRS, int(each.sum())))
                i = np.searchsorted(before, k, "right") - 1
                x = apart[i]
                y = lead[x] + k - before[i]
                go = np.flatnonzero((met.set[x] != met.set[y]) & (y != lead[x]))
                go = go[met.close(x[go], y[go], percent)]
                near[x[go]] = near[y[go]] = True
            yield out(met.key[near, 0], met.set[near], met.set[near], False)

    def out(token: np.ndarray, a: np.ndarray, b: np.ndarray, paired: bool) -> pa.RecordBatch:
        b = pa.array(b) if paired else pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(a), b], names=["token", "a", "b"])

    C.prepared(rows.sparkSession)
    return rows.mapInArrow(run, "token long, a long, b long")


def keywise(batches: Iterator[pa.RecordBatch]) -> Iterator[Met]:
    """Batches cut where keys end."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        met = Met.of(batch)
        met = met if held is None else met.after(held)
        end = int(met.cuts()[-2])
        held = met.slice(end, len(met))
        if end:
            yield met.slice(0, end)
    if held is not None:
        yield held


def later_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of sets of different labels that meet under a key (of different sides, if the key has two) and may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in keywise(batches):
            yield from pairs(met)

    def pairs(met: Met) -> Iterator[pa.RecordBatch]:
        cuts = met.cuts()
        low, high = np.minimum.reduceat(met.label, cuts[:-1]), np.maximum.reduceat(met.label, cuts[:-1])
        ends = np.repeat(cuts[1:], np.diff(cuts))
        more = ends - np.arange(len(met)) - 1  # rows after each under its key
        more[np.repeat(low == high, np.diff(cuts))] = 0
        before = np.cumsum(more) - more
        for lo in range(0, int(more.sum()), PAIRS):
            k = np.arange(lo, min(lo + PAIRS, int(more.sum())))
            x = np.searchsorted(before, k, "right") - 1
            y = x + 1 + k - before[x]
            cross = (met.key[x, 1] == met.key[x, 2]) | (met.side[x] != met.side[y])
            ok = np.flatnonzero((met.label[x] != met.label[y]) & cross)
            ok = ok[met.close(x[ok], y[ok], percent)]
            yield pair_rows(np.minimum(met.set[x[ok]], met.set[y[ok]]), np.maximum(met.set[x[ok]], met.set[y[ok]]))

    C.prepared(rows.sparkSession)
    return rows.mapInArrow(run, "a long, b long").distinct()


def pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def segments(documents: DataFrame, wanted: DataFrame, width: int, sketch, renumbered: np.ndarray, cuts, log2_bits: int) -> DataFrame:
    """(set, fragment, n, grams) of the wanted sets; a Bloom filter of them spares the others the shuffle."""
    bits = documents.sparkSession.sparkContext.broadcast(C.bloom_build(wanted.select("set"), log2_bits, 4))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, buf, offsets in blocks(batch.column(0)):
            sets = Shingles(buf, offsets, width, renumbered)
            for i in np.flatnonzero(C.bloom_has(bits.value, sets.ids, log2_bits, 4)).tolist():
                n = int(sets.n[i])
                own = sets.h[sets.begin[i] : sets.begin[i] + n]
                frag = np.searchsorted(cuts.value, order_keys(own, sketch.value), "right")
                which = np.unique(frag)
                grams = [own[frag == f].tobytes() for f in which]
                yield {"set": C.longs(np.repeat(sets.ids[i], len(which))), "fragment": which, "n": np.repeat(n, len(which)), "grams": grams}

    found = C.arrow_map(documents.select("text"), run, "set long, fragment int, n long, grams binary")
    return found.dropDuplicates(["set", "fragment"]).join(wanted, "set", "left_semi")


def verified(pairs: DataFrame, segs: DataFrame, percent: int, partners: int = 1024) -> DataFrame:
    """The pairs that are linked: overlaps counted for each fragment, then summed.

    A left segment is sent once to each of its places, one for about ``partners``
    partners, which are dealt among these, so a set with many isn't one task's.
    """
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(partners)).alias("places"))
    pairs = pairs.join(places, "a").select("a", "b", F.pmod(F.xxhash64("b"), "places").cast("int").alias("salt"))
    left = pairs.select("a", "salt").distinct().join(segs.withColumnRenamed("set", "a"), "a")
    left = left.select("a", "salt", "fragment", F.lit(None).cast("long").alias("b"), "grams")
    right = pairs.join(segs.withColumnRenamed("set", "b"), "b").select("a", "salt", "fragment", "b", "grams")
    both = left.unionByName(right).repartition("a", "salt", "fragment").sortWithinPartitions("a", "salt", "fragment", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            out_a, out_b, out_n = [], [], []
            data, offsets = flat(batch.column(4))
            for i, (a, salt, f, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                grams = data[offsets[i] : offsets[i + 1]]
                if b is None:
                    key, own = (a, salt, f), grams.copy().view(np.uint64)
                elif (a, salt, f) == key:
                    other = grams.copy().view(np.uint64)
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    out_a.append(a)
                    out_b.append(b)
                    out_n.append(int((own[at] == other).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], names=["a", "b", "shared"])

    C.prepared(pairs.sparkSession)
    total = both.mapInArrow(run, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    size = segs.groupBy("set").agg(F.max("n").alias("n"))
    sized = total.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
    return sized.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(set, label) of all sets in links: the smallest set of the component, by minimum labels and jumping."""
    edges = C.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    held = labels = C.written(edges.groupBy(F.col("a").alias("set")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("set")).agg(F.min("label").alias("near"))
        nxt = labels.join(near, "set").withColumn("low", F.least("label", "near"))
        up = labels.toDF("low", "up")
        nxt = nxt.join(up, "low", "left").select("set", F.coalesce(F.least("low", "up"), F.col("low")).alias("new"), (F.col("label")).alias("old"))
        nxt = C.written(nxt, "labels")
        C.discard(held)
        held, labels = nxt, nxt.select("set", F.col("new").alias("label"))
        if nxt.where("new <> old").isEmpty():
            C.discard(edges)
            return labels


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the key (token, low, high) and ``leads``: a token of over four blocks of sets is split into all pairs of its blocks.

    ``leads`` is 1 where the first set of the token (by ``place``, then number) is among those of the key.
    """
    crowded = rows.groupBy("token").agg(F.count("*").alias("count"), F.min(F.struct("place", "set")).alias("lead")).where(F.col("count") > 4 * block)
    crowded = C.written(crowded.select("token", F.ceil(F.col("count") / block).cast("int").alias("blocks"), F.col("lead.set").alias("lead")), "crowded")
    zero, one = F.lit(0), F.lit(1)
    if crowded.isEmpty():
        return rows.withColumns({"low": zero, "high": zero, "side": zero, "leads": one})
    blocks_of = F.coalesce("blocks", one)
    found = rows.join(crowded, "token", "left").withColumns({
        "own": F.pmod(F.xxhash64("set"), blocks_of).cast("int"), "first": F.coalesce(F.pmod(F.xxhash64("lead"), blocks_of), zero).cast("int"),
    })
    found = found.withColumn("other", F.explode(F.sequence(zero, blocks_of - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    leads = ((F.col("own") == F.col("first")) | (F.col("other") == F.col("first"))).cast("int")
    return found.withColumns({"low": low, "high": high, "side": (F.col("own") > F.col("other")).cast("int"), "leads": leads}).drop("blocks", "lead", "own", "other", "first")


def ngram_links(
    documents: DataFrame, width: int, percent: int, fragments: int, sketch_bits: int, log2_bits: int, block: int,
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n, set) of all documents, and the links (a, b) that make their sets' components."""
    spark = C.prepared(documents.sparkSession)
    texts = documents.select("doc_id", "text")
    docs, counts, renumbered = set_rows(texts, width, percent, sketch_bits)
    sketch = spark.sparkContext.broadcast(counts)
    cuts = spark.sparkContext.broadcast(pivots(counts, fragments))
    placed = prefix_rows(texts, width, percent, sketch, renumbered).repartition("token").dropDuplicates(["token", "set"])
    # Linked sets differ little in size, so a set stays at an n-gram only if the next smaller or larger one there may be linked by size.
    by_size = Window.partitionBy("token").orderBy("n")
    fits = lambda m: F.coalesce(F.abs(m - F.col("n")) <= F.floor((100 - percent) * (m + F.col("n")) / F.lit(100 + percent)), F.lit(False))
    placed = placed.withColumns({"smaller": F.lag("n").over(by_size), "larger": F.lead("n").over(by_size)})
    tokens = C.written(placed.where(fits(F.col("smaller")) | fits(F.col("larger"))).drop("smaller", "larger"), "tokens")
    # The leader of a token: of its sets the one that meets most others, relative to its size.
    weight = tokens.groupBy("set").agg((-F.count("*") / F.max("n")).cast("float").alias("place"))
    sets = C.written(docs.where("n > 0").groupBy("set").agg(F.first("parity").alias("parity"), F.first("fine").alias("fine")).join(weight, "set"), "met_sets")
    names = ["token", "low", "high", "set", "n", "label", "side", "parity"]
    rows = dealt(C.written(tokens.join(sets.drop("fine"), "set"), "token_sets"), block).withColumn("label", F.col("leads"))
    rows = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "place", "set").select(*names)
    near = C.written(survey(rows, percent), "near")
    first = C.written(near.where("b is not null").select("a", "b").distinct(), "first_pairs")
    wanted = C.written(first.select(F.col("a").alias("set")).union(first.select("b")).distinct(), "wanted")
    segs = C.written(segments(texts, wanted, width, sketch, renumbered, cuts, log2_bits), "segments")
    links = C.written(verified(first, segs, percent), "links")
    # Of the rest only pairs that the leaders' links don't join already.
    labels = components(links)
    apart = near.where("b is null").select("token", F.col("a").alias("set")).distinct().join(labels, "set", "left")
    apart = C.written(apart.withColumn("label", F.coalesce("label", "set")), "apart")
    several = apart.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    apart = apart.join(several, "token", "left_semi").join(tokens, ["token", "set"]).join(sets.drop("parity").withColumnRenamed("fine", "parity"), "set")
    apart = dealt(C.written(apart, "apart_sets"), block)
    apart = apart.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").select(*names)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = C.written(later_pairs(apart, percent).join(tried, ["a", "b"], "left_anti"), "second_pairs")
    C.discard(tokens, sets, first, near)
    more = C.written(second.select(F.col("a").alias("set")).union(second.select("b")).distinct().join(wanted, "set", "left_anti"), "wanted_more")
    extra = C.written(segments(texts, more, width, sketch, renumbered, cuts, log2_bits), "more_segments")
    later = C.written(verified(second, segs.unionByName(extra), percent), "later_links")
    C.discard(wanted, segs, second, more, extra)
    return docs, links.union(later)


def ngram_join(
    documents: DataFrame, width: int = 3, percent: int = 90, fragments: int = 4, sketch_bits: int = 22, log2_bits: int = 24, block: int = 1024, one_each: bool = False,
) -> DataFrame:
    """``documents`` with ``n_shingles`` and ``component_id`` (the smallest id that links reach).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    n-grams of ``width`` words.  ``sketch_bits`` and ``log2_bits`` set the fixed sizes
    of what is broadcast: 2**22 counters and a filter of 2**24 bits.  ``one_each``
    keeps one row, of the smallest id, of each component.
    """
    cols = C.Carried(documents, RESULT)
    slim = cols.frame.select(F.col(cols["doc_id"]).alias("doc_id"), F.col(cols["text"]).alias("text"))
    found = ngram_components(slim, width, percent, fragments, sketch_bits, log2_bits, block)
    found = found.select(F.col("doc_id").alias("id"), "row", *RESULT, "first").dropDuplicates(["id", "row"])
    hashed = cols.frame.withColumn("hash", F.xxhash64(cols["doc_id"], cols["text"]))
    out = hashed.join(found, (F.col("hash") == F.col("row")) & F.col(cols["doc_id"]).eqNullSafe(F.col("id")))
    if one_each:
        out = out.where("first").dropDuplicates(["hash", cols["doc_id"]])
    return cols.named(out, RESULT)


def ngram_components(
    documents: DataFrame, width: int = 3, percent: int = 90, fragments: int = 4, sketch_bits: int = 22, log2_bits: int = 24, block: int = 1024,
) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first) of each document, without its other columns.

    ``row`` is xxhash64(doc_id, text); ``first`` marks the row of the smallest id of a component.
    """
    docs, links = ngram_links(documents, width, percent, fragments, sketch_bits, log2_bits, block)
    labels = components(links)
    head = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")
    groups = docs.where("n > 0").groupBy("set").agg(F.min(head).alias("head"))
    low = C.written(groups.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")), "set_labels")
    least = low.groupBy("label").agg(F.min("head").alias("least"))
    ids = C.written(low.join(least, "label").select("set", "least"), "components")
    alone = F.col("n") == 0
    return docs.join(ids, "set", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))).alias("first"),
    )

"""Operator 2: quality rules on repetition inside a document.

Method: a suffix array over the words of each document (prefix doubling on word
ranks, whole blocks of documents at once), the longest common prefix of
neighbours by binary search over prefix hashes, and from these the maximal repeated
substrings.  An LCP interval of value L says that L words from each of its
suffixes repeat, so the longest repeat from a word is the larger LCP with its two
neighbours; the union of those spans is what repeats.  The rules limit the
fraction of characters so covered and the longest repeat.

Words are equal if 64-bit hashes are (exact up to eight bytes), lines if two such
hashes and the lengths are.

Defined results: a null or empty text has no words, so it fails the base rule.  Of
equal lines the first counts as new, the others as duplicates.  A very long text is a
block of its own, at some 60 bytes of memory a byte.  Identical rows get identical
results; an empty table gives an empty table; result columns replace input columns of
the same name, in any case; other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm import common as C
from folioforge.llm.textbytes import IS_BLANK, U64, PrefixHash, blocks, span_hashes, word_hashes, words

#: Neighbours in the suffix array that are compared at a time.
NEIGHBOURS = 1 << 17
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars_fraction double, "
    "longest_repeat long, repeat_spans array<struct<start:long,end:long>>, base_failed boolean, kept boolean"
)
NAMES = [x.split()[0] for x in RESULT.replace("start:long,end:long", "").split(", ")]


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of each word's suffix among all suffixes, by document; suffixes end with their document."""
    n = len(symbols)
    index = np.int32 if n < 1 << 31 else np.int64
    room = (np.searchsorted(doc, doc, "right") - np.arange(n)).astype(index)  # words left in the document
    order = np.lexsort((symbols, doc))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, index)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=index), 0))
    del order, new
    h = 1
    while True:
        many = np.bincount(rank, minlength=n) > 1
        tied = np.flatnonzero(many[rank]).astype(index)
        if not len(tied):
            return rank
        follow = np.full(len(tied), -1, index)
        far = room[tied] > h
        follow[far] = rank[tied[far] + h]
        o = np.lexsort((follow, rank[tied])).astype(index)
        r, f = rank[tied][o], follow[o]
        group = np.ones(len(o), bool)
        group[1:] = r[1:] != r[:-1]
        new = group.copy()
        new[1:] |= f[1:] != f[:-1]
        at = np.arange(len(o), dtype=index)
        r += np.maximum.accumulate(np.where(new, at, 0))
        r -= np.maximum.accumulate(np.where(group, at, 0))
        rank[tied[o]] = r
        h *= 2


def repeats(symbols: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each word, how many words from it on also occur elsewhere in its document (0 below ``least``).

    The common prefix of neighbours in the suffix array comes by binary search over
    prefix hashes, so no more than a few numbers a word are held.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    rank = suffix_ranks(symbols, doc)
    suffixes = np.empty_like(rank)
    suffixes[rank] = np.arange(n)
    del rank
    hashes = PrefixHash(symbols >> U64(4))
    for lo in range(0, n - 1, NEIGHBOURS):
        a = suffixes[lo : lo + NEIGHBOURS].astype(np.int64)
        b = suffixes[lo + 1 : lo + 1 + NEIGHBOURS].astype(np.int64)
        a = a[: len(b)]
        room = np.minimum(np.searchsorted(doc, doc[a], "right") - a, np.searchsorted(doc, doc[b], "right") - b)
        # Most neighbours don't share ``least`` words.
        near = np.flatnonzero((doc[a] == doc[b]) & (room >= least))
        near = near[hashes(a[near], a[near] + least) == hashes(b[near], b[near] + least)]
        a, b, low, high = a[near], b[near], np.full(len(near), least), room[near]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            same = hashes(x, x + mid) == hashes(y, y + mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        np.maximum.at(out, a, low)
        np.maximum.at(out, b, low)
    return out


def measure(buf: np.ndarray, offsets: np.ndarray, least: int) -> dict:
    """The counts of RESULT, without the verdicts, for the documents of a block."""
    n_docs = len(offsets) - 1
    count = np.int32 if len(buf) < 1 << 31 else np.int64

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, count)
        np.cumsum(flags, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)

    solid = ~IS_BLANK[buf]
    points = solid & ((buf & 0xC0) != 0x80)
    starts, ends, doc = words(buf, offsets)
    n_words = np.bincount(doc, minlength=n_docs)
    longest = repeats(word_hashes(buf, starts, ends), doc, least)
    begin = np.flatnonzero(longest)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + longest[begin], -1)
    cover = np.cumsum(cover)[:-1] > 0
    chars = np.zeros(len(buf) + 1, count)
    np.cumsum(points, out=chars[1:])
    size = chars[ends] - chars[starts]
    word_chars = per_doc(points)
    repeat_chars = np.bincount(doc, weights=size * cover, minlength=n_docs)
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, doc, longest)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    runs, base = edge.reshape(-1, 2), np.searchsorted(doc, np.arange(n_docs))
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    for x, y in runs.tolist():
        while x < y:  # a run of covered words may go on in the next document
            d = int(doc[x])
            stop = min(y, int(base[d] + n_words[d]))
            spans[d].append({"start": x - int(base[d]), "end": stop - int(base[d])})
            x = stop
    line = np.union1d(np.flatnonzero(buf == 10) + 1, offsets[:-1])
    line = line[line < len(buf)]
    dup = np.zeros(n_docs, np.int64)
    if len(line):
        end = np.append(line[1:], len(buf))
        end = end - ((buf[end - 1] == 10) & (end > line))
        has = np.zeros(len(buf) + 1, count)
        np.cumsum(solid, out=has[1:])
        worded = has[end] > has[line]
        line, end = line[worded], end[worded]
        key, check = (span_hashes(buf, line, end, seed) for seed in (0, 1))
        owner = np.searchsorted(offsets, line, "right") - 1
        o = np.lexsort((check, key, owner))
        again = np.ones(len(o) - 1, bool)
        for x in (key, check, owner, end - line):
            again &= x[o][1:] == x[o][:-1]
        dup = np.bincount(owner[o][1:][again], minlength=n_docs)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": per_doc(SYMBOLS[buf]), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc, weights=cover, minlength=n_docs).astype(np.int64),
        "repeat_chars_fraction": repeat_chars / np.maximum(word_chars, 1), "longest_repeat": top, "repeat_spans": spans,
    }


def quality_rules(
    documents: DataFrame, window: int = 5, min_words: int = 10, max_repeat_percent: int = 20,
    max_repeat_chars: float = 0.3, max_longest_repeat: int = 200,
) -> DataFrame:
    """``documents`` with the counts, ``base_failed`` and ``kept``.

    The base rule fails a document with under ``min_words`` words or with over
    ``max_repeat_percent`` of its words in repeats of ``window`` words.  What passes
    is kept if repeats cover at most ``max_repeat_chars`` of the characters of its
    words and none is over ``max_longest_repeat`` words.
    """
    cols = C.Carried(documents, NAMES)
    where = cols.at("text")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, buf, offsets in blocks(batch.column(where)):
            got = measure(buf, offsets, window)
            n = got["n_words"]
            got["base_failed"] = (n < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * n)
            got["kept"] = ~got["base_failed"] & (got["repeat_chars_fraction"] <= max_repeat_chars) & (got["longest_repeat"] <= max_longest_repeat)
            yield cols.batch(batch, lo, hi - lo) | got

    return cols.named(C.arrow_map(cols.frame, run, cols.schema(RESULT)), NAMES)

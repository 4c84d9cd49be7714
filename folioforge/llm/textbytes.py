"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A column of texts is handled as the one byte buffer that Arrow holds anyway,
block by block, so that NumPy does the work of whole blocks and no Python
object is made for a word, a shingle or a line.  All classes used here (the six
ASCII blanks, ``A-Z``, the line feed) are single bytes that never occur inside
a multi-byte UTF-8 character, so byte positions are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BLOCK_BYTES = 1 << 20

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The prefix hash works modulo this Mersenne prime: modulo a power of two, polynomial hashes of
#: some strings (Thue-Morse) are equal for every base.
PRIME = U64((1 << 61) - 1)
_BASE = 0x1E3779B97F4A7C15
_LIMB, _LIMB_MASK = U64(30), U64((1 << 30) - 1)
_LOW32 = U64(0xFFFFFFFF)
#: Numbers that are summed before a reduction: 2**16 products of 39 bits stay far below 2**64.
_SEGMENT = 1 << 16
#: Longer spans are hashed one by one, by a hash made for that.
_LANES = 64
_CACHED = 1 << 14
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and its n + 1 offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets from 0).

    A single text is never cut, so a text longer than ``limit`` is a block of its own.
    """
    data, offsets = flat(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo PRIME."""
    out = x & PRIME
    out += x >> U64(61)
    out -= PRIME * (out >= PRIME)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    out = np.empty(len(a), U64)
    for lo in range(0, len(a), _CACHED):  # in parts that stay in the processor's cache
        x, y = a[lo : lo + _CACHED], b[lo : lo + _CACHED]
        x1, x0, y1, y0 = x >> U64(32), x & _LOW32, y >> U64(32), y & _LOW32
        middle = x1 * y0
        middle += x0 * y1
        x0 *= y0
        x1 *= y1
        x1 <<= U64(3)
        x1 += middle >> U64(29)
        middle &= U64((1 << 29) - 1)
        middle <<= U64(32)
        x1 += middle
        x1 += x0 >> U64(61)
        x0 &= PRIME
        x1 += x0
        out[lo : lo + _CACHED] = reduced(x1)
    return out


def powers(count: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < count."""
    have = _powers.get(base)
    if have is None or len(have[0]) < count:
        size = 1 << max(16, int(count - 1).bit_length())
        prime, out = int(PRIME), []
        for step in (base, pow(base, -1, prime)):
            x, n = np.ones(size, U64), 1
            while n < size:
                for lo in range(0, n, _CACHED):
                    part = x[lo : min(lo + _CACHED, n)]
                    x[n + lo : n + lo + len(part)] = product(part, np.full(len(part), pow(step, n, prime), U64))
                n *= 2
            out.append(x)
        have = _powers[base] = out[0], out[1]
    return have[0][:count], have[1][:count]


class PrefixHash:
    """Prefix polynomial hashes of a row of bytes or other numbers below 2**60: the hash of any part in constant time."""

    def __init__(self, row: np.ndarray, base: int = _BASE):
        up, self.down = powers(len(row) + 1, base)
        self.sums = np.zeros(len(row) + 1, U64)
        narrow = row.dtype == np.uint8
        for lo in range(0, len(row), _SEGMENT):
            part = row[lo : lo + _SEGMENT].astype(U64) + U64(1)
            step = up[lo : lo + len(part)]
            if narrow:  # the limbs of products are those of the powers, times a byte
                high, low = np.cumsum(part * (step >> _LIMB)), np.cumsum(part * (step & _LIMB_MASK))
            else:
                part = product(part, step)
                high, low = np.cumsum(part >> _LIMB), np.cumsum(part & _LIMB_MASK)
            high = reduced(high)
            shifted = (high >> U64(31)) + ((high & U64((1 << 31) - 1)) << _LIMB)  # high * 2**30
            self.sums[lo + 1 : lo + 1 + len(part)] = reduced(shifted + reduced(low) + self.sums[lo])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return product(reduced(self.sums[end] + (PRIME - self.sums[start])), self.down[start])


def gram_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``width`` bytes: below 8, or 8 times a power of two.

    Eight bytes go through a bijection; wider hashes are sums of two halves, one multiplied.
    """
    n = max(0, len(buf) - width + 1)
    out = np.empty(n, U64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    for lo in range(0, n, _CACHED):
        x = eight[lo : min(lo + _CACHED, n) + max(width, 8) - 8].copy()
        if width < 8:
            x &= U64((1 << 8 * width) - 1)
        x = mix(x + U64(0x9E3779B97F4A7C15))
        step, odd = 8, 0xA0761D6478BD642F
        while step < width:
            more = x[: len(x) - step] * U64(odd)
            more += x[step:]
            x, step, odd = more, 2 * step, (odd * 0xE7037ED1A0B428DB + 2) & ((1 << 64) - 1)
        out[lo : lo + _CACHED] = mix(x)
    return out


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the document index of all words (runs of non-blank bytes)."""
    solid = ~IS_BLANK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    if len(buf):
        before[0], before[1:] = False, solid[:-1]
        before &= ~edge[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    if len(buf):
        after[-1], after[:-1] = False, solid[1:]
        after &= ~edge[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes at a time go through a bijection.

    Spans of equal length up to eight bytes never collide.
    """
    if len(starts) > 1 << 17:
        return np.concatenate([span_hashes(buf, starts[k : k + (1 << 17)], ends[k : k + (1 << 17)], seed) for k in range(0, len(starts), 1 << 17)])
    size = ends - starts
    out = mix(size.astype(U64) + U64(0xC2B2AE3D27D4EB4F + seed))
    if not len(size):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    long = np.flatnonzero(size > 8 * _LANES)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    live = np.flatnonzero((size > 0) & (size <= 8 * _LANES)) if len(long) else np.flatnonzero(size)
    at, left = starts[live], size[live]
    while len(live):
        lane = eight[at]
        short = left < 8
        lane[short] &= (U64(1) << (left[short].astype(U64) << U64(3))) - U64(1)
        out[live] = mix(out[live] ^ lane)
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return out


word_hashes = span_hashes


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document's runs of ``width`` words, sorted by document, and their document index.

    A document of 1 to ``width - 1`` words has the whole sequence as its one shingle; one without words has none.
    """
    if lower:
        buf = LOWER[buf]
    starts, ends, doc = words(buf, offsets)
    h = word_hashes(buf, starts, ends)
    n = len(h)
    parts, owners = [], []
    if n >= width:
        run = np.zeros(n - width + 1, U64)
        for i in range(width):
            run = mix(run * U64(0x9FB21C651E98DF25) + h[i : n - width + 1 + i] + U64(1))
        whole = doc[: n - width + 1] == doc[width - 1 :]
        parts.append(run[whole])
        owners.append(doc[: n - width + 1][whole])
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    for size in range(1, width):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            first = np.searchsorted(doc, rows)
            run = np.full(len(rows), U64(size))
            for i in range(size):
                run = mix(run * U64(0xA24BAED4963EE407) + h[first + i] + U64(1))
            parts.append(run)
            owners.append(rows)
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)], strict=True):
        hashes[lo:hi].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]

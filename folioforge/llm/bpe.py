"""Operator 1: byte-level BPE encoding and decoding.

Method: each pre-token's symbols form a doubly linked list; a priority queue holds
the mergeable pairs by rank and position; an entry whose symbols have changed
since it was pushed is stale and skipped.  Decoding concatenates the strings of
the vocabulary.  A bounded cache keeps the ids of pre-tokens already merged.

The vocabulary is read by the driver from a file named by a parameter and sent to
the workers once (it has a fixed size).  Nothing is trained.

Defined results: a null text counts as empty and has no ids.  Ids of added tokens
come from their exact strings in a text, as the tokenizers library has it.  Very long
texts and words are encoded whole.  Of pairs of one rank the first merges first.
Identical rows get identical results; an empty table gives an empty table; result
columns replace input columns of the same name, in any case; other columns pass through
under any name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioforge.llm import common as C

#: The pre-token pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces to look up whole.  A pre-token never reaches over the last blank before a non-blank, so a
#: text cut before each of those gives the same pre-tokens as the whole.
#: (Python's classes count U+001C to U+001F as blanks; Unicode's White_Space doesn't.)
_S, _N = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
PIECES = re.compile(f"{_S}?{_N}+|{_S}+(?={_S}{_N})|{_S}+").findall
#: Entries of a generation of the two caches of a worker, about 220 bytes each; each cache has two generations.
TOKEN_ENTRIES, PIECE_ENTRIES = 100_000, 200_000
CACHED_CHARS = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: The rank of a pair of ids, and the id that the merge of a rank makes.
        self.ranks = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [vocab[a + b] for a, b in merges]
        self.byte_ids = [vocab.get(c, -1) for c in letters]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pre_tokens = regex.compile(PATTERN).findall
        self.tokens = BoundedCache(TOKEN_ENTRIES, lambda token: array("i", self.merge(token.encode())).tobytes())
        self.cache = BoundedCache(PIECE_ENTRIES, self.piece)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token.

        The list's links are ``after`` and ``before``; ``rank[i]`` is the rank of the pair that starts
        at i now, or -1.  A queue entry is one number, rank and position, for cheap comparison.
        """
        byte_ids, find, made = self.byte_ids, self.ranks.get, self.made
        ids = [byte_ids[b] for b in data]
        n = len(ids)
        if n == 1:
            return ids
        shift = n.bit_length()
        mask = (1 << shift) - 1
        rank = [find(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # noqa: B905
        rank.append(-1)
        queue = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        if not queue:
            return ids
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & mask
            r = entry >> shift
            if rank[i] != r:
                continue  # stale: one of the two has been merged since
            j = after[i]
            k = after[i] = after[j]
            ids[i] = new = made[r]
            ids[j] = rank[j] = rank[i] = -1
            if k < n:
                before[k] = i
                if (r := find(new << 32 | ids[k], -1)) >= 0:
                    rank[i] = r
                    heappush(queue, r << shift | i)
            h = before[i]
            if h >= 0:
                rank[h] = r = find(ids[h] << 32 | new, -1)
                if r >= 0:
                    heappush(queue, r << shift | h)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """The ids of a piece as the bytes of 32-bit numbers."""
        return b"".join(map(self.tokens.__getitem__, self.pre_tokens(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as the bytes of 32-bit numbers."""
        if self.split_added is None or not any(t in text for t in self.added):
            return b"".join(map(self.cache.__getitem__, PIECES(text)))
        out = []
        for k, part in enumerate(self.split_added.split(text)):
            out.append(np.int32(self.added[part]).tobytes() if k % 2 else b"".join(map(self.cache.__getitem__, PIECES(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary's strings of the ids, one after the other, as valid UTF-8."""
        data = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return data.decode("utf-8", "replace").encode()


class BoundedCache(dict):
    """Ids of strings seen before, in two generations of up to ``entries`` each.

    A string found in the old generation moves to the young one; when that is full
    it becomes the old one, so what is used again and again stays.
    """

    def __init__(self, entries: int, make: Callable[[str], bytes]):
        super().__init__()
        self.entries, self.make, self.old = entries, make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
            if len(text) > CACHED_CHARS:
                return found
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[text] = found
        return found


_coders: dict[str, ByteBPE] = {}


def coder_of(name: str, spec) -> ByteBPE:
    """The worker's coder for a vocabulary; it lives as long as the worker does."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = ByteBPE(spec.value)
    return _coders[name]


def bpe_round_trip(documents: DataFrame, vocabulary: str, decode: bool = True) -> DataFrame:
    """``documents`` with ``ids`` (array of int) and ``decoded`` (the text that the ids stand for)."""
    spark = C.prepared(documents.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    spec = {"model": {"vocab": spec["model"]["vocab"], "merges": spec["model"]["merges"]}, "added_tokens": spec.get("added_tokens", [])}
    shared = spark.sparkContext.broadcast(spec)
    name = f"{spark.sparkContext.applicationId}:{vocabulary}"
    names = ["ids", *["decoded"] * decode]
    cols = C.Carried(documents, names)
    where = cols.at("text")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        coder = coder_of(name, shared)
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids = [coder.encode(x or "") for x in part.column(where).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            got = {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}
            if decode:
                got["decoded"] = pa.array(map(coder.decode, ids), pa.binary()).cast(pa.string())
            yield cols.batch(part) | got

    return cols.named(C.arrow_map(cols.frame, run, cols.schema("ids array<int>" + ", decoded string" * decode)), names)

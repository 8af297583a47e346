"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, all others by a heap over linked bytes.

A vocabulary is a table of byte strings and their ranks.  It is bounded by its
file, so the driver reads it once and broadcasts it.  Texts are rows; nothing
is shuffled.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spiketide.llm.frames import Shared, map_rows
from spiketide.llm.pretokens import PieceTable

MASK = (1 << 64) - 1
MAX_VOCABULARY = 1 << 20  # a broadcast stays below some 50 MB
KEPT = 240_000  # pieces and pre-tokens that a worker remembers, in each of two generations; some 200 MB at most


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one "base64 rank" line per token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY} are broadcast")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    return ranks


class MinimalPerfectHash:
    """n keys to the slots 0 .. n - 1 without collision: hash, displace, compare.

    Keys fall into n / 2 buckets.  From the largest bucket on, each takes the
    first displacement that puts its keys into free slots; a bucket of one key
    names its slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        owner = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        single = next((k for k, b in enumerate(order) if len(members[b]) < 2), len(order))
        for b in order[:single]:
            d = 0
            while True:
                slots = {self._slot(hashes[i], d) for i in members[b]}
                if len(slots) == len(members[b]) and all(owner[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in members[b]:
                owner[self._slot(hashes[i], d)] = i
        free = (s for s in range(n) if owner[s] < 0)
        for b in order[single:]:
            if members[b]:
                slot = next(free)
                owner[slot], self.shift[b] = members[b][0], -slot - 1
        self.keys = [keys[i] for i in owner]
        self.at = owner

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & MASK) >> 24) % self.n

    def find(self, key: bytes) -> int:
        """Place of the key in the list it was built from; -1 if it is not there."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.at[slot] if self.keys[slot] == key else -1


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the lowest-ranked pair of neighbours joins first, the leftmost of equals."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i stops; 0 once it is joined to its left
    before = list(range(-1, n))
    rank = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= stop or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if i and (r := rank(word[(left := before[i]) : stop])) is not None:
            heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encoder of one vocabulary, made once in a Python worker."""

    def __init__(self, tokens: list[bytes], ids: list[int], hashed: MinimalPerfectHash, pattern: str):
        self.ids, self.hashed = ids, hashed
        self.ranks = dict(zip(tokens, ids))
        self.known = PieceTable(pattern, self.packed, b"".join, KEPT, KEPT)

    def packed(self, word: str) -> bytes:
        raw = word.encode()
        at = self.hashed.find(raw)
        out = [self.ids[at]] if at >= 0 else merged(raw, self.ranks)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        return self.known.of_text(text)


class Decoder:
    """Bytes of ids: lengths and places of the tokens, gathered from one blob."""

    STEP = 1 << 18

    def __init__(self, tokens: list[bytes], ids: list[int]):
        size = [0] * (max(ids, default=-1) + 1)
        token = [b""] * len(size)
        for t, i in zip(tokens, ids):
            size[i], token[i] = len(t), t
        self.size = np.array(size, "<i8")
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(token), "u1")

    def decode(self, ids: bytes) -> bytes:
        every = np.frombuffer(ids, "<u4")
        return b"".join(self._part(every[k : k + self.STEP]) for k in range(0, len(every), self.STEP))

    def _part(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        if not size.all():
            raise ValueError("an id without a token")
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.blob[at].tobytes()


class Both(NamedTuple):
    encoder: Encoder
    decoder: Decoder


def _both(tokens: list[bytes], ids: list[int], hashed: MinimalPerfectHash, pattern: str) -> Both:
    return Both(Encoder(tokens, ids, hashed, pattern), Decoder(tokens, ids))


class Codec(NamedTuple):
    """Both directions of one vocabulary, broadcast apart: a decoding worker holds no more than the tokens."""

    encoder: Shared
    decoder: Shared
    both: Shared


def share(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> Codec:
    """Vocabulary, its hash and the pattern of pre-tokens for the executors."""
    spark, tokens = df.sparkSession, list(ranks)
    ids = [ranks[t] for t in tokens]
    whole = tokens, ids, MinimalPerfectHash(tokens), pattern
    return Codec(Shared(spark, whole, Encoder), Shared(spark, (tokens, ids), Decoder), Shared(spark, whole, _both))


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text as packed little-endian unsigned 32-bit integers.

    Rows: ``id_col``, ``ids`` (binary), one for each row of ``docs``, repeated
    rows and null ids included.  A null text counts as empty and has no ids.
    Only the two columns are read, so extra columns do not matter; an empty
    table gives an empty one.  A very long text is cut into pieces.
    """

    def start():
        encoder = codec.encoder.get()

        def row(key, text: str | None) -> Iterator[tuple]:
            yield key, encoder.encode(text or "")

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, ids binary", start)


def decode(encoded: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of packed ids; keeps the ids.  A null counts as no ids; an unknown id is an error."""

    def start():
        decoder = codec.decoder.get()

        def row(key, ids: bytes | None) -> Iterator[tuple]:
            yield key, ids, decoder.decode(ids or b"")

        return row

    kind = encoded.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary"
    return map_rows(encoded.select(id_col, ids_col), ddl, start)


def round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass: one Python worker a task holds both."""

    def start():
        encoder, decoder = codec.both.get()

        def row(key, text: str | None) -> Iterator[tuple]:
            ids = encoder.encode(text or "")
            yield key, ids, decoder.decode(ids)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, ids binary, decoded binary", start, rows=64)


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Token count and digests of the ids and of what they decode to; on demand the packed ids."""
    codec = share(docs, ranks, pattern)
    both = round_trip(docs, codec, id_col)
    return both.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )

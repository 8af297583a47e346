"""Token counts by byte-pair merging on a linked list with a heap; ids are never made."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spiketide.llm.bpe import MAX_VOCABULARY
from spiketide.llm.frames import Shared, map_rows
from spiketide.llm.pretokens import PieceTable

Merges = dict[tuple[int, int], tuple[int, int]]


def byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_merges(path: str) -> tuple[Merges, list[str]]:
    """Merge table over symbol numbers (bytes first) and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    if missing := [c for c in letters if c not in spec["model"]["vocab"]]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    number: dict[str, int] = dict(letters)
    merges: Merges = {}
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        made = number.setdefault(a + b, len(number))
        merges[number[a], number[b]] = rank, made
    if len(merges) > MAX_VOCABULARY:
        raise ValueError(f"{len(merges)} merges; at most {MAX_VOCABULARY} are broadcast")
    return merges, [t["content"] for t in spec["added_tokens"]]


def merges_of(word: bytes, table: Merges) -> int:
    """How many merges a word takes: pop the lowest rank, join, link, until the heap is empty."""
    symbols = list(word)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    find = table.get
    heap = [(*m, i, i + 1) for i in range(n - 1) if (m := find((symbols[i], symbols[i + 1])))]
    heapify(heap)
    done = 0
    while heap:
        _, made, i, j = heappop(heap)
        if after[i] != j or symbols[i] < 0 or symbols[j] < 0 or find((symbols[i], symbols[j]), (0, -1))[1] != made:
            continue
        done += 1
        symbols[i], symbols[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if m := find((made, symbols[k])):
                heappush(heap, (*m, i, k))
        if (h := before[i]) >= 0 and (m := find((symbols[h], made))):
            heappush(heap, (*m, h, i))
    return done


class Counter:
    """Counts of one vocabulary, made once in a Python worker."""

    def __init__(self, table: Merges, special: list[str], pattern: str):
        self.table = table
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = PieceTable(pattern, self.counted, sum)

    def counted(self, word: str) -> int:
        raw = word.encode()
        return len(raw) - (merges_of(raw, self.table) if len(raw) > 1 else 0)

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token and ends the text around it."""
        if not self.special or not self.special.search(text):
            return self.known.of_text(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.known.of_text(p) for p in parts if p)


def token_counts(
    docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of each text, and whether the tokens exceed ``limit``.

    One row for each row of ``docs``, repeated rows and null ids included.  A
    null text counts as empty: no bytes, no tokens.  Only the two columns are
    read, so extra columns do not matter; an empty table gives an empty one.
    """
    shared = Shared(docs.sparkSession, (*read_merges(path), pattern), Counter)

    def start():
        counter = shared.get()

        def row(key, text: str | None) -> Iterator[tuple]:
            text = text or ""
            yield key, len(text.encode()), counter.count(text)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    counts = map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, n_bytes long, n_tokens long", start)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)

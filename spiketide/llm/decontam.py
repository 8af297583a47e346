"""Benchmark decontamination over a positional inverted index that is stored in segments of documents.

Every segment holds the postings of some documents: for each benchmark term the
positions at which it stands.  A segment has about 400,000 words, so postings
are built, stored and searched without any shuffle, and no list of a frequent
term ever meets in one task.  A window of benchmark words is found by shifting
the lists of its terms by their offsets and intersecting them from the rarest
term on, so that most windows end at an empty first list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spiketide.llm.frames import Shared, as_schema, map_batches, map_rows
from spiketide.session import stage

# fixed values: a word is a run of ASCII digits, letters, and all characters beyond ASCII
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: the same by bytes of UTF-8: characters beyond ASCII have bytes from 0x80 on only; what separates words is a space
_BYTES = bytes(c if c >= 0x80 else ord(chr(c).translate(_LOWER)) if _WORD.match(chr(c)) else 0x20 for c in range(256))

WINDOW = 10
SEGMENT_WORDS = 400_000
BLOCK_CHARS = 16_000_000  # benchmark text that is broadcast at a time
NEAR_TERMS, NEAR_SLOP = 4, 2
HITS = (
    "`{key}` {kind}, row string, n_words long, spans array<struct<start:int,end:int>>, items array<{item}>, near array<{item}>"
)
GAP = WINDOW + NEAR_SLOP + 1  # free positions between documents; no match crosses them

INDEX = "ids array<{kind}>, rows array<string>, sizes array<int>, terms array<int>, counts array<int>, positions array<int>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


def windows_of(words: list[str]) -> list[list[str]]:
    """All runs of WINDOW words; a shorter text with a word is one window."""
    return [words[i : i + WINDOW] for i in range(max(1, len(words) - WINDOW + 1))] if words else []


class Vocabulary:
    """Numbers of the benchmark's terms by their UTF-8."""

    def __init__(self, terms: list[str]):
        self.known = {t.encode(): i for i, t in enumerate(terms)}

    def numbers(self, text: bytes | None) -> np.ndarray:
        """The term at each word of a text, -1 where a word is no term."""
        words = text.translate(_BYTES).split() if text else []
        return np.fromiter(map(self.known.get, words, repeat(-1)), "<i4", len(words))


def build_index(docs: DataFrame, terms: list[str], id_col: str, text_col: str, row_col: str) -> DataFrame:
    """One row for each segment: its documents, and for each term the positions in the segment."""
    shared = Shared(docs.sparkSession, (terms,), Vocabulary)
    schema = as_schema(INDEX.format(kind=docs.schema[id_col].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.get().numbers
        ids, rows, sizes, streams, total = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            at, parts = 0, []
            for stream in streams:
                hit = np.flatnonzero(stream >= 0)
                parts.append((stream[hit], hit + at))
                at += len(stream) + GAP
            term = np.concatenate([p[0] for p in parts])
            place = np.concatenate([p[1] for p in parts])
            order = np.argsort(term, kind="stable")
            distinct, counts = np.unique(term, return_counts=True)
            values = ids, rows, sizes, distinct, counts, place[order]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for k in range(batch.num_rows):
                stream = numbers(texts[k].as_py())
                if streams and total + len(stream) > SEGMENT_WORDS:
                    yield segment()
                    ids, rows, sizes, streams, total = [], [], [], [], 0
                ids.append(batch.column(0)[k].as_py())
                rows.append(batch.column(2)[k].as_py())
                sizes.append(len(stream))
                streams.append(stream)
                total += len(stream) + GAP
        if streams:
            yield segment()

    return map_batches(docs.select(id_col, text_col, row_col), run, schema)


def term_counts(index: DataFrame) -> dict[int, int]:
    """Occurrences of each benchmark term in all documents; as many rows as the vocabulary has terms."""

    def start():
        def row(terms: list[int], counts: list[int]) -> Iterator[tuple]:
            yield from zip(terms, counts)

        return row

    each = map_rows(index.select("terms", "counts"), "term int, n long", start, rows=1)
    return {r.term: r.n for r in each.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Searcher:
    """Windows by item, each with its (term, offset) from the rarest on."""

    def __init__(self, items: list, windows: list[tuple[int, list[tuple[int, int]]]]):
        self.items, self.windows = items, windows

    def search(self, seg: dict) -> Iterator[tuple]:
        """Per document: id, row, words, spans of exact matches, items, items met in proximity only."""
        sizes = seg["sizes"].astype("<i8")
        starts = np.concatenate([[0], np.cumsum(sizes + GAP)])
        positions, counts = seg["positions"].astype("<i8"), seg["counts"].astype("<i8")
        ends = np.cumsum(counts)
        postings = {t: positions[e - n : e] for t, e, n in zip(seg["terms"].tolist(), ends.tolist(), counts.tolist())}
        change = np.zeros(int(starts[-1]) + 1, "<i4")
        exact: dict[int, set[int]] = {}
        near: dict[int, set[int]] = {}
        nothing = np.empty(0, "<i8")

        def documents(places: np.ndarray) -> set[int]:
            return set((np.searchsorted(starts, places, "right") - 1).tolist())

        for item, terms in self.windows:
            first, offset = terms[0]
            at = postings.get(first, nothing) - offset
            close = at
            for k, (term, offset) in enumerate(terms[1:], 1):
                if not len(close):
                    break
                shifted = postings.get(term, nothing) - offset
                if k < NEAR_TERMS:
                    close = close[distance(shifted, close) <= NEAR_SLOP]
                if len(at):
                    at = at[distance(shifted, at) == 0]
                if k >= NEAR_TERMS and not len(at):
                    break
            if len(at):
                np.add.at(change, at, 1)
                np.add.at(change, at + len(terms), -1)
                for d in documents(at):
                    exact.setdefault(d, set()).add(item)
            if len(terms) >= NEAR_TERMS and len(close):
                for d in documents(np.maximum(close, 0)):
                    near.setdefault(d, set()).add(item)
        edges = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype("i1"), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        owner = np.searchsorted(starts, begin, "right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()):
            spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
        name = self.items
        for d, (key, row, n) in enumerate(zip(seg["ids"], seg["rows"], sizes.tolist())):
            found = {name[i] for i in exact.get(d, ())} - {None}
            missed = {name[i] for i in near.get(d, ())} - found - {None}
            yield key, row, n, spans.get(d, []), sorted(found), sorted(missed)


def distance(ordered: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How far each place is from the nearest of an ordered list."""
    if not len(ordered):
        return np.full(len(places), 1 << 40)
    k = np.searchsorted(ordered, places)
    above = np.abs(ordered[np.minimum(k, len(ordered) - 1)] - places)
    return np.minimum(above, np.abs(ordered[np.maximum(k - 1, 0)] - places))


def _search_block(docs: DataFrame, items: list[tuple], item_kind: str, id_col: str, text_col: str, row_col: str) -> DataFrame:
    kept = [(key, words) for key, text in items if (words := words_of(text))]
    number: dict[str, int] = {}
    for _, words in kept:
        for w in words:
            number.setdefault(w, len(number))
    index = stage(build_index(docs, list(number), id_col, text_col, row_col))
    counts = Counter(term_counts(index)) if kept else Counter()
    windows: dict[tuple, None] = {}
    for i, (_, words) in enumerate(kept):
        for window in windows_of(words):
            terms = sorted(((number[w], k) for k, w in enumerate(window)), key=lambda x: (counts[x[0]], x))
            windows[i, tuple(terms)] = None
    shared = Shared(docs.sparkSession, ([k for k, _ in kept], list(windows)), Searcher)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = as_schema(HITS.format(key=id_col, kind=kind, item=item_kind))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.get()
        for batch in batches:
            for k in range(batch.num_rows):
                seg = {}
                for name, column in zip(batch.schema.names, batch.columns):
                    seg[name] = column[k].values
                    seg[name] = seg[name].to_pylist() if name in ("ids", "rows") else seg[name].to_numpy(zero_copy_only=False)
                columns = zip(*searcher.search(seg))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(index, run, schema)


def _joined(parts: DataFrame, ddl: str) -> DataFrame:
    """One row for each document from what the blocks of the benchmark found in it."""
    flat = parts.groupBy("row").agg(
        *(F.first(c).alias(c) for c in parts.columns if c not in ("row", "spans", "items", "near")),
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")),
    )

    def start():
        def row(*values) -> Iterator[tuple]:
            *head, spans, items, near = values
            union: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans):
                if union and s[0] <= union[-1][1]:
                    union[-1][1] = max(union[-1][1], s[1])
                else:
                    union.append(list(s))
            found = set(items)
            yield *head, [tuple(s) for s in union], sorted(found), sorted(set(near) - found)

        return row

    return map_rows(flat.select(*parts.columns), ddl, start)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Where the texts hold passages of a benchmark.

    One row for each row of ``docs``: ``id_col``, ``n_words``, ``spans`` (merged
    [start, end) word positions of exact matches), ``items`` (whose windows
    occur) and ``near`` (items met in proximity only: the rarest terms of a window
    stand within NEAR_SLOP positions of where they should).

    The benchmark goes out in blocks of ``block_chars`` characters, so neither
    the driver nor a broadcast holds more of it at once.  A null text has no
    words; an item without words matches nothing; an item without an id marks
    words but is not listed; repeated items count once; empty tables give no
    hits or no rows.  Only the named columns are read.
    """
    n = F.coalesce(F.char_length(item_text), F.lit(0))
    total = benchmark.agg(F.sum(n).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_chars))
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    pick = F.pmod(F.xxhash64(item_text), F.lit(blocks))
    bench = benchmark.select(item_col, item_text)
    plain = docs.select(id_col, text_col, F.lit(None).cast("string").alias("_row"))
    if blocks > 1:  # results of several blocks meet again by a row key that is written once
        plain = stage(plain.withColumn("_row", F.expr("uuid()")))
    parts = None
    for b in range(blocks):
        items = [tuple(r) for r in bench.filter(pick == b).collect()] if blocks > 1 else [tuple(r) for r in bench.collect()]
        part = _search_block(plain, items, item_kind, id_col, text_col, "_row")
        parts = part if parts is None else parts.union(part)
    if blocks > 1:
        parts = _joined(parts, HITS.format(key=id_col, kind=docs.schema[id_col].dataType.simpleString(), item=item_kind))
    return parts.select(id_col, "n_words", "spans", "items", "near")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hit words, number and digest of the items, and the verdict of each document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

"""Alignment of two tokenizers over the same texts, by merge paths.

Both tokenizers cut a text into tokens with byte ends.  Where an A token and a
B token end at one byte, a group of tokens closes.  The two sorted lists of ends
are merged along a path; diagonals at equal distances cross the path at points
that a binary search finds, so the path falls into pieces of equal work however
unevenly texts are long.  Each piece finds the ends that both of its sides
have, and what a diagonal has parted is stitched.

Linked pairs of ids are counted over the corpus.  Rows for single links would
be as many as the tokens, so a task numbers the distinct pairs of some CHUNK_BYTES
of text: a document keeps numbers, the pairs travel once for each chunk, and the
corpus counts come back to the chunk the same way.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spiketide.llm.bpe import MAX_VOCABULARY
from spiketide.llm.frames import Shared, as_schema, map_batches
from spiketide.llm.token_counts import byte_letters
from spiketide.session import stage

CHUNK_BYTES = 16 << 20  # text whose distinct pairs are numbered together
SLICE_CHARS = 1 << 20  # text that is merged together
PIECE = 1 << 14  # ends in a piece of the path
MAX_WORDS, MAX_WORD_TOKENS = 150_000, 3_000_000  # known words are forgotten beyond
MAX_MODEL_BYTES = 64 << 20
SHIFT = 20  # a pair of ids in one number: A's id above, B's below

# fixed value: how the byte-level pre-tokenizer cuts
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Between a visible character and one space that a visible character follows, both tokenizers end a token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
JOINED = 128  # new words that are cut together


def read_byte_level(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level BPE file whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or not plain or odd or spec.get("normalizer"):
        raise ValueError(f"not a plain byte-level BPE file: {pre}, {odd}")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError("ids do not follow the order of the merges")
    letters = byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if len(ranks) > MAX_VOCABULARY or max(ranks.values()) >= MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; ids up to {MAX_VOCABULARY} are handled")
    return ranks


def read_pieces(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of more than {MAX_MODEL_BYTES} bytes is not broadcast")
    return model


def words_of(text: str) -> list[str]:
    """Parts of a text that stand behind one space each, the first behind the space put before the text."""
    if not text:
        return []
    odd = text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_SPACE)
    return _CUT.split(text) if odd else text.split(" ")


def crossings(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals at multiples of ``step`` cross the merge path; of equal ends A's comes first."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        at, over = mid[open_], (d - mid - 1)[open_]
        ahead = a[at] <= b[over]
        low[open_] = np.where(ahead, at + 1, low[open_])
        high[open_] = np.where(ahead, high[open_], at)
    return low, d - low


def common_in_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends that both sides of a piece have."""
    if not len(a) or not len(b):
        return np.empty(0, "i8"), np.empty(0, "i8")
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return hit, at[hit]


def common_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all equal ends: pieces by themselves, then what the diagonals have parted."""
    i, j = crossings(a, b, step)
    found = [(np.empty(0, "i8"), np.empty(0, "i8"))]
    for k in range(len(i) - 1):
        x, y = common_in_piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        found.append((x + i[k], y + j[k]))
        p, q = i[k + 1], j[k + 1]
        if p and q < len(b) and a[p - 1] == b[q]:  # one end on either side of the diagonal
            found.append((np.array([p - 1]), np.array([q])))
    left, right = (np.concatenate(side) for side in zip(*found))
    return left, right


class Side(NamedTuple):
    """Tokens of all known words of one tokenizer, end to end."""

    ids: np.ndarray
    start: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Side:
        return cls(*(np.empty(0, "i8") for _ in range(3)))

    def more(self, ids: np.ndarray, n: np.ndarray) -> Side:
        start = np.cumsum(n) - n + len(self.ids)
        return Side(*(np.concatenate(x) for x in ((self.ids, ids), (self.start, start), (self.n, n))))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words at ``at``, and how many each has."""
        n = self.n[at]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(self.start[at] - before, n) + np.arange(n.sum())], n


class Part(NamedTuple):
    """Some words of a document, merged: counts, linked pairs, and the groups as text."""

    n_a: int
    n_b: int
    links: np.ndarray
    groups: bytes


class Aligner:
    """Both tokenizers and the words they have cut, made once in a Python worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if n > MAX_VOCABULARY or any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces that go on across a space are not handled")
        self.bytes_a = {i: t for t, i in ranks.items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.zeros(max(self.bytes_a) + 1, "i8")
        self.size_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.size_b = np.array([len(t) for t in self.bytes_b], "i8")
        most = max(len(self.size_a), n)
        self.figures = np.zeros((most, len(str(most)) + 1), "u1")
        self.n_figures = np.array([len(str(k)) for k in range(most)], "i8")
        for k in range(most):
            self.figures[k, : self.n_figures[k]] = np.frombuffer(str(k).encode(), "u1")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.side_a, self.side_b = Side.empty(), Side.empty()
        self.bad: set[str] = set()

    def learn(self, words: list[str]) -> bool:
        """Cut the words that are not known; false if a tokenizer does not give some word's bytes back."""
        if len(self.known) > MAX_WORDS or len(self.side_a.ids) > MAX_WORD_TOKENS:
            self.forget()
        different = set(words)
        if new := [w for w in different if w not in self.known]:
            smooth = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
            parts = [smooth[k : k + JOINED] for k in range(0, len(smooth), JOINED)]
            if len(smooth) < len(new):
                joinable = set(smooth)
                parts += [[w] for w in new if w not in joinable]
            new = [w for part in parts for w in part]
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            texts = [" ".join(part) for part in parts]
            cut_a, cut_b = [self.a(" " + t) for t in texts], self.b.encode(texts, num_threads=1)
            raw = [(" " + t).encode() for t in texts]
            if self.gives(cut_a, self.bytes_a, raw) and self.gives(cut_b, self.bytes_b, raw):
                ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in new), "i8", len(new)))
            else:
                cut_a, cut_b = self.one_by_one(new)
                ends = None
            for name, cut, size in (("side_a", cut_a, self.size_a), ("side_b", cut_b, self.size_b)):
                ids = np.fromiter(chain.from_iterable(cut), "i8", sum(map(len, cut)))
                words_end = np.cumsum(list(map(len, cut))) if ends is None else np.searchsorted(np.cumsum(size[ids]), ends, "right")
                setattr(self, name, getattr(self, name).more(ids, np.diff(words_end, prepend=0)))
        return self.bad.isdisjoint(different) if self.bad else True

    @staticmethod
    def gives(cut: list[list[int]], token: Mapping[int, bytes] | list[bytes], raw: list[bytes]) -> bool:
        return all(b"".join(map(token.__getitem__, ids)) == r for ids, r in zip(cut, raw))

    def one_by_one(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of each word; a word that does not come back is marked and has none."""
        cut_a, cut_b = [self.a(" " + w) for w in words], self.b.encode(words, num_threads=1)
        for k, w in enumerate(words):
            raw = [(" " + w).encode()]
            if not (self.gives([cut_a[k]], self.bytes_a, raw) and self.gives([cut_b[k]], self.bytes_b, raw)):
                self.bad.add(w)
                cut_a[k] = cut_b[k] = []
        return cut_a, cut_b

    def merged(self, parts: list[list[str]]) -> list[Part]:
        """Word lists, whose words are known and good, merged in one go."""
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), "i8", sum(map(len, parts)))
        a, per_word_a = self.side_a.gather(at)
        b, per_word_b = self.side_b.gather(at)
        i, j = common_ends(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        pairs = a[i] << SHIFT | b[j]
        text, stop = self.written(a, b, i, j)
        last = np.cumsum([0, *map(len, parts)])
        ends_a = np.concatenate([[0], np.cumsum(per_word_a)])[last]
        ends_b = np.concatenate([[0], np.cumsum(per_word_b)])[last]
        group = np.searchsorted(i, ends_a)  # groups that end before a part ends
        out = []
        for k in range(len(parts)):
            links = pairs[group[k] : group[k + 1]]
            first = stop[group[k] - 1] if group[k] else 0
            written = text[first : stop[group[k + 1] - 1] - 1] if len(links) else b""
            out.append(Part(int(ends_a[k + 1] - ends_a[k]), int(ends_b[k + 1] - ends_b[k]), links, written))
        return out

    def written(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` for all groups, and where each group's text ends."""
        if not len(i):
            return b"", np.empty(0, "i8")
        first_a, first_b = np.append(0, i + 1), np.append(0, j + 1)
        group_a, group_b = (np.repeat(np.arange(len(i)), np.diff(f)) for f in (first_a, first_b))
        place_a, place_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + first_a[group_b + 1]
        ids, mark = np.empty(len(a) + len(b), "i8"), np.full(len(a) + len(b), ord(","), "u1")
        ids[place_a], ids[place_b] = a, b
        mark[place_a[i]], mark[place_b[j]] = ord("|"), ord(";")
        n = self.n_figures[ids]
        rows = self.figures[ids]
        rows[np.arange(len(ids)), n] = mark
        text = rows[np.arange(rows.shape[1]) <= n[:, None]]
        return text.tobytes(), np.cumsum(n + 1)[place_b[j]]


class Chunk:
    """Documents whose distinct pairs are numbered together, and the rows they become."""

    def __init__(self, schema: pa.Schema, keep_groups: bool):
        self.schema, self.keep_groups = schema, keep_groups
        self.rows: list[tuple] = []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # distinct pairs of a document in order, and their counts
        self.size = 0

    def add(self, key, parts: list[Part], digest: str, groups: str | None, size: int) -> None:
        links = np.concatenate([p.links for p in parts]) if parts else np.empty(0, "i8")
        self.links.append(np.unique(links, return_counts=True))
        n = len(links)
        self.rows.append((key, sum(p.n_a for p in parts), sum(p.n_b for p in parts), n, n, digest, groups))
        self.size += size

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """Pairs of the chunk with their numbers and counts, and the documents with numbers in place of pairs."""
        pairs, at = np.unique(np.concatenate([p for p, _ in self.links]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([n for _, n in self.links]), len(pairs)).astype("i8")
        yield self.batch(len(pairs), chunk=[number] * len(pairs), idx=np.arange(len(pairs), dtype="i4"), pair=pairs, n=counts)
        packed, low = [], 0
        for own, n in self.links:
            packed.append(pack(at[low : low + len(own)], n))
            low += len(own)
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
        values = dict(zip(names, map(list, zip(*self.rows))))
        yield self.batch(len(self.rows), chunk=[number] * len(self.rows), links=packed, **values)

    def batch(self, size: int, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(size, f.type) for f in self.schema], schema=self.schema)


def pack(idx: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers as steps, and how often each occurs, in as few bytes as the largest of them allows."""
    steps = np.diff(idx, prepend=0)
    wide = bytes([2 if not len(idx) or steps.max() < 1 << 16 else 4, 1 if not len(n) or n.max() < 1 << 8 else 4])
    return wide + steps.astype(f"<u{wide[0]}").tobytes() + n.astype(f"<u{wide[1]}").tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, count = packed[0], packed[1]
    m = (len(packed) - 2) // (step + count)
    steps = np.frombuffer(packed, f"<u{step}", m, 2)
    return np.cumsum(steps, dtype="i8"), np.frombuffer(packed, f"<u{count}", m, 2 + step * m).astype("i8")


class Aligned(NamedTuple):
    """``docs``: a row for each row of the input; ``pairs``: (chunk, idx, pair, n) for each pair of a chunk."""

    docs: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> Aligned:
    """Both tokenizations of every text, cut into groups where tokens of both end.

    ``docs`` of the result: ``id, n_a, n_b, n_groups, n_links, groups_sha256``, on
    demand ``groups`` (the text behind the digest), and what :func:`counted`
    needs.  One row for each row, repeated rows and null ids included.  Null
    and empty texts have no tokens, nor has a text that one of the tokenizers
    does not give back byte for byte: counts of 0 and an empty digest.  A long
    text is merged part by part.  Only two columns are read, so extra columns
    do not matter; an empty table gives empty ones.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = as_schema(
        f"chunk long, idx int, pair long, n long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary"
    )
    arrow = to_arrow_schema(schema)
    shared = Shared(docs.sparkSession, (read_byte_level(path_a), read_pieces(path_b)), Aligner)

    def done(key, parts: list[Part], chunk: Chunk, size: int) -> None:
        digest, written = hashlib.sha256(), []
        for k, p in enumerate(parts):
            for x in (b";" if k else b"", p.groups):
                digest.update(x)
                if keep_groups:
                    written.append(x)
        groups = b"".join(written).decode() if keep_groups else None
        chunk.add(key, parts, digest.hexdigest() if parts else "", groups, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.get()
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(arrow, keep_groups)
        for slice_ in slices(batches):
            for key, parts, size in _parts(aligner, slice_):
                done(key, parts, chunk, size)
            if chunk.size >= CHUNK_BYTES:
                yield from chunk.batches(number)
                number, chunk = number + 1, Chunk(arrow, keep_groups)
        if chunk.rows:
            yield from chunk.batches(number)

    found = stage(map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema))
    return Aligned(found.filter("idx is null").drop("idx", "pair", "n"), found.filter("idx is not null").select("chunk", "idx", "pair", "n"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (id, text) in lists of some SLICE_CHARS; a longer text is a list of its own."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(text or "")
            if held and size + n > SLICE_CHARS:
                yield held
                held, size = [], 0
            held.append((key, text))
            size += n
    if held:
        yield held


def _parts(aligner: Aligner, rows: list[tuple]) -> Iterator[tuple]:
    """(id, parts, size) of each row of a slice."""
    words = [words_of(text or "") for _, text in rows]
    if len(rows) == 1 and len(rows[0][1] or "") > SLICE_CHARS:
        blocks = list(_blocks(words[0]))
        good = all([aligner.learn(b) for b in blocks])
        merged = [aligner.merged([b])[0] for b in blocks if aligner.learn(b)] if good else []
        yield rows[0][0], merged, len(rows[0][1])
        return
    if not aligner.learn([w for ws in words for w in ws]):
        words = [ws if aligner.bad.isdisjoint(ws) else [] for ws in words]
    full = [k for k, ws in enumerate(words) if ws]
    merged = dict(zip(full, aligner.merged([words[k] for k in full])))
    for k, (key, text) in enumerate(rows):
        yield key, [merged[k]] if k in merged else [], len(text or "")


def _blocks(words: list[str]) -> Iterator[list[str]]:
    low, size = 0, 0
    for k, w in enumerate(words):
        if size > SLICE_CHARS:
            yield words[low:k]
            low, size = k, 0
        size += len(w) + 1
    yield words[low:]


def pair_counts(aligned: Aligned) -> DataFrame:
    """``pair, a_id, b_id, count, is_best``: how many links hold a pair, and whether no pair of its B id has more."""
    counts = stage(aligned.pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    counts = counts.withColumn("b_id", F.col("pair").bitwiseAND((1 << SHIFT) - 1)).withColumn("a_id", F.shiftright("pair", SHIFT))
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("is_best"))


def counted(aligned: Aligned) -> DataFrame:
    """The documents with ``n_best`` (links whose pair is the best of its B id) and ``count_sum`` (counts over all links)."""
    looked_up = aligned.pairs.join(pair_counts(aligned), "pair").select(F.col("chunk").alias("of"), "idx", "count", "is_best")
    out = as_schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.docs.drop("chunk", "links").schema) + ", n_best long, count_sum long")
    arrow = to_arrow_schema(out)

    def of_chunk(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        size = pairs.num_rows
        counts, best = np.zeros(size, "i8"), np.zeros(size, "i8")
        at = pairs["idx"].to_numpy()
        counts[at], best[at] = pairs["count"].to_numpy(), pairs["is_best"].to_numpy(zero_copy_only=False)
        sums = []
        for packed in docs["links"].to_pylist():
            idx, n = unpack(packed)
            sums.append((int(best[idx] @ n), int(counts[idx] @ n)))
        kept = docs.drop_columns(["chunk", "links"])
        n_best, count_sum = zip(*sums) if sums else ((), ())
        added = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
        return pa.Table.from_arrays([*kept.columns, *added], names=[*kept.column_names, "n_best", "count_sum"]).cast(arrow)

    return aligned.docs.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(of_chunk, out)

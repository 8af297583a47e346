"""Language of a text by rank-order profiles of n-grams.

A profile lists the most frequent 1-, 2- and 3-grams of letters in order.  A
document goes to the language whose profile is least out of place: for each of
the document's grams the distance between its two ranks, or PROFILE where the
language does not list it.

Texts are lower-cased, every run of other characters becomes one space, and a
space stands before the first and after the last letter, so grams know where
words begin and end.  A gram is three code points of 21 bits in one number,
whose order is that of the strings.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spiketide.llm.frames import Shared, as_schema, map_batches, map_rows
from spiketide.session import stage

PROFILE = 400  # grams in a profile
SAMPLE_PER_LANG = 2_000  # documents of a language that its profile is made of
MAX_LANGS = 4_096  # profiles are broadcast: MAX_LANGS x PROFILE numbers at most
BLOCK = 1 << 18  # characters whose grams are counted at once
UNKNOWN = "und"
_BITS = 21
_SPACE = 32


class Letters:
    """Which code points are letters, and which letters or marks on them."""

    _own: Letters | None = None

    def __init__(self) -> None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        self.letter = np.array([k == "L" for k in kinds])
        self.inside = np.array([k in "LM" for k in kinds])

    @classmethod
    def get(cls) -> Letters:
        """Made once in a worker."""
        cls._own = cls._own or cls()
        return cls._own

    def points(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text with one space for each run of other characters, and one at either end.

        Empty if the text has no letter.
        """
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        inside = self.inside[code]
        if not self.letter[code].any():
            return np.empty(0, "i8")
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # a word starts behind another character
        if inside[0]:
            start = np.append(0, start)
        word = np.cumsum(np.bincount(start, minlength=len(code)))
        kept = np.flatnonzero(inside)
        out = np.full(len(kept) + len(start) + 1, _SPACE, "i8")
        out[np.arange(len(kept)) + word[kept]] = code[kept]
        return out


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and their counts; a space alone is no gram."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, len(points), BLOCK):
        p = points[low : low + BLOCK + 2]
        n = min(BLOCK, len(p))
        one = p << (2 * _BITS)
        two = one[:-1] | (p[1:] << _BITS)
        three = two[:-1] | p[2:]
        single = one[:n][p[:n] != _SPACE]
        found.append(np.unique(np.concatenate([single, two[:n], three[:n]]), return_counts=True))
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([c for c, _ in found] or [np.empty(0, "i8")]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found] or [np.empty(0)]), len(codes)).astype("i8")


def profile(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent grams, most frequent first; of equal ones the smaller string."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def text_of(code: int) -> str:
    points = [code >> (2 * _BITS), code >> _BITS & ((1 << _BITS) - 1), code & ((1 << _BITS) - 1)]
    return "".join(map(chr, filter(None, points)))


def sample(docs: DataFrame, learn: Column, id_col: str = "doc_id", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Ids of the documents that profiles are learned from: of each language the ``per_lang`` with the smallest digest of the id.

    Only ids and languages are read; tasks pass on at most ``per_lang`` rows of a language.
    """
    rows = docs.filter(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("language")).distinct()
    order = W.partitionBy("language").orderBy(F.sha2(F.col("key").cast("string"), 256), "key")
    return rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).select("key", "language")


def profiles(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """``language, gram, n, rank`` (from 0): the profile of each language among the sampled documents that ``learn`` allows.

    Null languages, ids and texts are never learned from.  Grams are counted in
    each task and added up; rows of one id and language count each for itself.
    """
    picked = stage(sample(docs, learn, id_col, lang_col, per_lang))
    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("language"))
    chosen = chosen.filter(F.col("text").isNotNull()).join(picked, ["key", "language"]).select("language", "text")
    schema = as_schema("language string, gram long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters.get()
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for language, text in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(language, []).append(letters.points(text))
            for language, texts in by.items():
                parts = [grams(p) for p in texts if len(p)]
                if parts:
                    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype("i8")
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes)), pa.array(codes), pa.array(n)], schema=arrow)

    counts = map_batches(chosen, run, schema).groupBy("language", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("language").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < PROFILE)


class Judge:
    """All profiles as one table: a row of ranks for each gram that any language lists."""

    def __init__(self, languages: list[str], listed: list[tuple[int, int, int]]):
        self.languages = languages
        self.codes = np.array(sorted({g for _, g, _ in listed}), "i8")
        self.ranks = np.full((len(self.codes) + 1, len(languages)), -1, "i4")
        for language, gram, rank in listed:
            self.ranks[np.searchsorted(self.codes, gram), language] = rank
        self.letters = Letters.get()

    def judge(self, text: str) -> tuple[str, float]:
        points = self.letters.points(text) if text else ()
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0
        own = profile(*grams(points))
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = -1
        ranks = self.ranks[at]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.languages[best], 1 - int(away[best]) / (PROFILE * len(own))


def predict(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` of each row: 1 less the share of the greatest distance that is possible.

    Of languages at one distance the first in order of its name is taken.  A
    null text, one without a letter, and every text if nothing was learned is
    ``und`` with score 0.  Repeated rows and null ids stay; only two columns
    are read, so extra columns do not matter; an empty table gives an empty one.
    """
    rows = learned.select("language", "gram", "rank").limit(MAX_LANGS * PROFILE + 1).collect()
    if len(rows) > MAX_LANGS * PROFILE:
        raise ValueError(f"more than {MAX_LANGS} languages")
    languages = sorted({r["language"] for r in rows}, key=str.encode)
    number = {x: k for k, x in enumerate(languages)}
    shared = Shared(docs.sparkSession, (languages, [(number[r["language"]], r["gram"], r["rank"]) for r in rows]), Judge)

    def start():
        judge = shared.get().judge

        def row(key, text: str | None) -> Iterator[tuple]:
            yield key, *judge(text or "")

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(pairs, f"id {kind}, lang_pred string, score double", start)

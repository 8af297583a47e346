"""Toxicity by multiple-instance learning: a document is as toxic as its sentences, joined by noisy-or.

Labels exist for documents only.  A sentence has the probability
p = sigmoid(bias + sum of the weights of its words' features), a document
P = 1 - product of (1 - p).  The likelihood of the document labels is climbed by
gradients that each task sums over its rows; the driver sees one vector of
the size of the vocabulary for each task and round.  Scoring a document gives
the scores of its sentences on the way, which locates the offending ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spiketide.llm.frames import Shared, as_schema, map_batches, map_rows
from spiketide.llm.pretokens import Recent
from spiketide.session import stage

SAMPLE_PER_LABEL = 4_000  # labelled documents of each class that the fit sees, on average; picked by a hash of the id
MAX_FEATURES = 50_000
MIN_GAIN = 20.0  # log-likelihood ratio of a feature; chance alone reaches it in about one of a million
PREFIXES = (4, 5, 6)
ROUNDS = 60
RATE, SHRINK = 0.25, 5e-5
BIAS = -6.0
TASKS = 12
CUT, SENTENCE_CUT = 0.7, 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_/\\…«»“”‘’¡¿"


def features_of(token: str) -> list[str]:
    """A word in lower case and its beginnings."""
    word = token.lower().strip(_EDGES)
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)] if word else []


def sample(labels: DataFrame, learn: Column, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """(id, _y) of about ``per_label`` labelled rows of each class."""
    rows = labels.select(id_col, F.col(label_col).alias("_y")).filter(learn & F.col(id_col).isNotNull() & F.col("_y").isin(0, 1))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, per_label / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): documents of either class that have it."""
    schema = as_schema("feature string, pos long, neg long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Recent(features_of, 200_000)
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            columns = names, [seen[1][f] for f in names], [seen[0][f] for f in names]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for y, text in zip(batch.column(0), batch.column(1)):
                tokens = set((text.as_py() or "").split())
                seen[y.as_py()].update({f for t in tokens for f in made[t]})
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    each = map_batches(rows.select("_y", "text"), run, schema)
    return each.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: list[float]
    bias: float


class Scorer:
    """Sentence and document scores, with what each token adds kept in a bounded memo."""

    def __init__(self, features: list[str], weights: list[float], bias: float):
        weight = dict(zip(features, weights))
        self.bias = bias
        self.adds = Recent(lambda token: sum(weight.get(f, 0.0) for f in features_of(token)), 150_000)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """P of the text, and (start, end, p) of its offending sentences in code points."""
        adds, bias = self.adds.__getitem__, self.bias
        clean, found = 0.0, []
        for m in _SENTENCE.finditer(text):
            words = m.group().split()
            if words:
                s = bias + sum(map(adds, words))
                clean -= math.log1p(math.exp(s)) if s < 30 else s
                if s >= 0:
                    found.append((m.start(), m.end(), 1 / (1 + math.exp(-s))))
        return -math.expm1(clean), found


def _sentences(rows: DataFrame, features: list[str]) -> DataFrame:
    """(y, n, sizes, ids): sentences of a document, and the known features of those that have any."""
    number = {f: i for i, f in enumerate(features)}
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def start():
        known = shared.value
        made = Recent(lambda token: tuple(known[f] for f in features_of(token) if f in known), 200_000)

        def row(y: int, text: str | None) -> Iterator[tuple]:
            n, sizes, ids = 0, [], []
            for m in _SENTENCE.finditer(text or ""):
                words = m.group().split()
                n += bool(words)
                got = [i for w in words for i in made[w]]
                if got:
                    sizes.append(len(got))
                    ids += got
            if n:
                yield y, n, sizes, ids

        return row

    return map_rows(rows.select("_y", "text"), "y int, n int, sizes array<int>, ids array<int>", start)


def _gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sum over the documents of the gradient of -log likelihood; the last place is the bias."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            y = batch.column(0).to_numpy().astype("i8")
            n = batch.column(1).to_numpy().astype("i8")
            per_doc = np.diff(batch.column(2).offsets.to_numpy())
            sizes = batch.column(2).flatten().to_numpy().astype("i8")
            ids = batch.column(3).flatten().to_numpy().astype("i8")
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            doc = np.repeat(np.arange(len(y)), per_doc)
            s = weights[-1] + np.bincount(sentence, weights[ids], len(sizes))
            p = np.exp(-np.logaddexp(0, -s))
            p0 = 1 / (1 + math.exp(-weights[-1]))
            empty = n - per_doc
            clean = -np.bincount(doc, np.logaddexp(0, s), len(y)) - empty * np.logaddexp(0, weights[-1])
            toxic = np.maximum(-np.expm1(clean), 1e-12)
            pull = np.where(y == 1, -np.exp(clean) / toxic, 1.0)  # d(-log likelihood) / ds = pull * p
            by_sentence = pull[doc] * p
            total[:-1] += np.bincount(ids, by_sentence[sentence], size - 1)
            total[-1] += by_sentence.sum() + (pull * empty * p0).sum()
        yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

    parts = map_batches(rows, run, as_schema("g binary")).collect()  # TASKS vectors at most
    return sum((np.frombuffer(bytes(r.g)) for r in parts), np.zeros(size))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
) -> Model:
    """Weights from the labelled documents that ``learn`` allows, about ``per_label`` of each class.

    Null ids, null labels and null texts teach nothing.  Without documents of both
    classes the model has no features and finds nothing toxic.
    """
    picked = stage(sample(labels, learn, id_col, label_col, per_label))  # bounded, so its size lets Spark broadcast it
    rows = stage(docs.select(id_col, F.col(text_col).alias("text")).join(picked, id_col).select("_y", "text"))
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], [], BIAS)
    pos, neg = F.col("pos"), F.col("neg")
    odds = F.log((pos + 0.5) / (sizes[1] + 1.0)) - F.log((neg + 0.5) / (sizes[0] + 1.0))
    share = sizes[1] / (sizes[0] + sizes[1])
    gain = 2 * (pos * F.log((pos + 1e-9) / ((pos + neg) * share)) + neg * F.log((neg + 1e-9) / ((pos + neg) * (1 - share))))
    counts = _feature_counts(rows).select("feature", odds.alias("odds"), gain.alias("gain"))
    best = counts.filter((F.col("gain") >= MIN_GAIN) & (F.col("odds") > 0)).orderBy(F.desc("gain"), "feature").limit(MAX_FEATURES).collect()
    if not best:
        return Model([], [], BIAS)
    features = [r.feature for r in best]
    x = stage(_sentences(rows, features).coalesce(TASKS))
    w = np.array([*(0.5 * r.odds for r in best), BIAS])
    total = sizes[0] + sizes[1]
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, ROUNDS + 1):  # gradients with momentum and a scale of their own for each weight
        g = _gradient(x, w) / total
        g[:-1] += SHRINK * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(features, w[:-1].tolist(), float(w[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` in [0, 1], ``predicted`` (1 from CUT on) and ``offending`` of each row.

    ``offending`` lists (start, end, score) of the sentences with a score of
    SENTENCE_CUT or more, in code points.  Null and empty texts have no sentence and score
    0; null ids and repeated rows stay; an empty table gives an empty one; only two columns are read.
    """
    shared = Shared(docs.sparkSession, (model.features, model.weights, model.bias), Scorer)

    def start():
        scorer = shared.get()

        def row(key, text: str | None) -> Iterator[tuple]:
            yield key, *scorer.score(text or "")

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, score double, offending array<struct<start:int,end:int,score:double>>"
    scored = map_rows(docs.select(id_col, text_col), ddl, start)
    return scored.select(id_col, "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")

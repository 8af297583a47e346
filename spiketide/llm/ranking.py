"""Quality by Bradley-Terry ranking: scores learned from preference pairs, cut where the labelled rows err least.

Every labelled row is learned from.  Rows are dealt out by a hash of their id
into buckets of bounded size, and pairs are made inside a bucket; where one class
is rare, its rows stand in several buckets with a weight less.  A Newton step is
one pass over the buckets that passes on a few numbers of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spiketide.llm.frames import as_schema, map_batches, map_rows
from spiketide.session import stage

BUCKET_ROWS = 8_192  # labelled rows that meet for pairs, on average
RARE_ROWS = 64  # rows of the rarer class in a bucket, on average, by copies if need be
PAIRS_PER_ROW = 4
PENALTY = 1e-3  # of the squared weights
STEPS, SETTLED = 50, 1e-8
CELLS = 256  # of the raw scores, for the cut
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "words symbols exclamations capitals stutter variety repeated_windows repeated_lines word_length shortness digits"
).split()
CUT = 0.3


def features_of(text: str | None) -> list[float]:
    """Shares and lengths of one text, each between 0 and about 10; all 0 for a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = n - 4
    return [
        math.log1p(n),
        math.sqrt(sum(map(text.count, SYMBOLS)) / chars),
        math.sqrt(text.count("!") / chars),
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        math.log(len(set(words)) + 1) / math.log(n + 1),
        1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / windows if windows > 0 else 0.0,
        1 - len(set(lines)) / len(lines),
        chars / n,
        1 / math.sqrt(n),
        math.sqrt(sum(map(text.count, "0123456789")) / chars),
    ]


def featurise(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns and ``features`` (array of doubles), one row for each row."""

    def start():
        def row(*values) -> Iterator[tuple]:
            *kept, text = values
            yield *kept, features_of(text)

        return row

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", features array<double>"
    return map_rows(docs.select(*keep, text_col), ddl, start)


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid(w (x - mean) / scale - threshold + logit(CUT)), so that CUT lies at the threshold."""

    weights: list[float]  # already divided by the scale
    threshold: float  # raw score with the fewest errors
    quantile: float

    def score(self, features: Column | str) -> Column:
        xs = F.col(features) if isinstance(features, str) else features
        raw = F.lit(-self.threshold + math.log(CUT / (1 - CUT)))
        for k, w in enumerate(self.weights):
            raw = raw + xs[k] * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))


def _pairs(z: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences of good and bad rows, and their weights: each row meets PAIRS_PER_ROW rows of the other class."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.empty((0, z.shape[1])), np.empty(0)
    draw = np.random.default_rng(seed)
    left = np.concatenate([np.repeat(good, PAIRS_PER_ROW), draw.choice(good, len(bad) * PAIRS_PER_ROW)])
    right = np.concatenate([draw.choice(bad, len(good) * PAIRS_PER_ROW), np.repeat(bad, PAIRS_PER_ROW)])
    return z[left] - z[right], np.repeat(np.concatenate([weight[good], weight[bad]]), PAIRS_PER_ROW)


def _slopes(diff: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed weight, loss, gradient and curvature of pairs at w, in one row of numbers."""
    at = diff @ w
    p = 1 / (1 + np.exp(np.clip(at, -500, 500)))
    curved = diff.T @ (diff * (weight * p * (1 - p))[:, None])
    return np.concatenate([[weight.sum(), weight @ np.logaddexp(0, -at)], diff.T @ (weight * p), curved.ravel()])


def _newton(slopes: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The weights with the least mean loss and penalty; a step that does not lower them is halved."""
    w, step, least = np.zeros(d), np.zeros(d), math.inf
    for _ in range(STEPS):
        got = slopes(w + step)
        if not got[0]:
            break
        mean = got[1:] / got[0]
        loss = mean[0] + PENALTY / 2 * ((w + step) ** 2).sum()
        if loss > least + 1e-12:
            step = step / 2
            continue
        w, least = w + step, loss
        step = np.linalg.solve(mean[1 + d :].reshape(d, d) + PENALTY * np.eye(d), mean[1 : 1 + d] - PENALTY * w)
        if np.abs(step).max() < SETTLED:
            break
    return w


def rank(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Bradley-Terry on hashed preference pairs of rows that one process holds: the fit of one bucket.

    With one class alone there are no pairs: all scores are equal and every row passes.
    """
    good, bad = (y == 1).sum(), (y == 0).sum()
    if not good or not bad:
        return Ranking([0.0] * len(FEATURES), math.log(CUT / (1 - CUT)), 0.0)
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    diff, weight = _pairs(x / scale, y, np.ones(len(y)), 0)
    w = _newton(lambda w: _slopes(diff, weight, w), x.shape[1]) / scale
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    ranked = raw[order]
    # errors of either class, as shares, if the lowest k rows are rejected
    below_good = np.concatenate([[0], np.cumsum(y[order] == 1)]) / good
    above_bad = 1 - np.concatenate([[0], np.cumsum(y[order] == 0)]) / bad
    cost = below_good + above_bad
    cost[1:-1][ranked[1:] == ranked[:-1]] = np.inf  # equal scores stay on one side
    k = int(np.argmin(cost))
    lower = ranked[k - 1] if k else ranked[0] - 1
    upper = ranked[k] if k < len(ranked) else ranked[-1] + 1
    return Ranking(w.tolist(), float((lower + upper) / 2), k / len(raw))


def crc(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Ranking:
    """Fit on all labelled rows that ``learn`` allows; null ids and null labels are never learned from."""
    return fit_features(stage(featurise(docs, id_col, text_col=text_col)), labels, learn, id_col, label_col)


def fit_features(featured: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", label_col: str = "quality") -> Ranking:
    """``fit`` on rows of ``featurise``; the driver gets the sums of each bucket, never rows."""
    rows = labels.select(id_col, F.col(label_col).cast("int").alias("y")).filter(learn & F.col(id_col).isNotNull() & F.col("y").isin(0, 1))
    known = stage(featured.join(rows, id_col).select(F.xxhash64(id_col).alias("h"), "y", "features"))
    d = len(FEATURES)
    spread = [F.stddev_pop(F.col("features")[k]) for k in range(d)]
    bad, good, *scale = known.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1), *spread).first()
    if not good or not bad:
        return Ranking([0.0] * d, math.log(CUT / (1 - CUT)), 0.0)
    scale = np.array([s if s >= 1e-9 else 1.0 for s in scale])
    buckets = stage(_buckets(known, good, bad))

    def slopes(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, sums = batch.column(0).to_pylist(), []
                for bucket, x, y, weight in zip(at, *(c.to_pylist() for c in batch.columns[1:])):
                    z = np.frombuffer(x).reshape(-1, d) / scale
                    sums.append(_slopes(*_pairs(z, np.frombuffer(y, "i4"), np.frombuffer(weight), bucket), w).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at, "i8"), pa.array(sums, "binary")], names=["bucket", "sums"])

        each = map_batches(buckets, run, as_schema("bucket long, sums binary")).collect()
        return np.sum([np.frombuffer(r["sums"]) for r in sorted(each, key=lambda r: r["bucket"])], axis=0)

    w = _newton(slopes, d) / scale
    raw = sum((F.col("features")[k] * F.lit(float(v)) for k, v in enumerate(w)), F.lit(0.0))
    threshold, quantile = _cut(known.select("y", raw.alias("raw")), good, bad)
    return Ranking(w.tolist(), threshold, quantile)


def _buckets(known: DataFrame, good: int, bad: int) -> DataFrame:
    """One row a bucket: features, classes and weights of its labelled rows, packed, whatever the partitions."""
    many = -(-(good + bad) // BUCKET_ROWS)
    rare, fewer = (1, good) if good <= bad else (0, bad)
    copies = min(many, -(-RARE_ROWS * many // fewer))
    stands = F.when(F.col("y") == rare, copies).otherwise(1)
    dealt = known.select("*", (1.0 / stands).alias("weight"), F.explode(F.sequence(F.lit(0), stands - 1)).alias("copy"))
    dealt = dealt.withColumn("bucket", F.pmod(F.pmod("h", F.lit(many)) + F.col("copy"), F.lit(many)))

    def pack(table: pa.Table) -> pa.Table:
        x = table["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        y, h, weight = (table[c].to_numpy() for c in ("y", "h", "weight"))
        order = np.lexsort((*x.T[::-1], h, y))
        packed = [pa.array([a[order].tobytes()], "binary") for a in (x, y.astype("i4"), weight)]
        return pa.Table.from_arrays([pa.array([table["bucket"][0].as_py()], "i8"), *packed], names=["bucket", "x", "y", "weight"])

    return dealt.select("bucket", "h", "y", "weight", "features").groupBy("bucket").applyInArrow(pack, "bucket long, x binary, y binary, weight binary")


def _cut(scored: DataFrame, good: int, bad: int) -> tuple[float, float]:
    """Threshold with the fewest errors of either class, as shares, and the share of rows below it, exact over all rows.

    The rows are counted in cells of the scores.  A cut inside a cell rejects at best all its bad rows and none
    of its good ones, so only cells that can beat the best cut between cells are ordered.
    """
    values = stage(scored.groupBy("raw").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")))
    borders = sorted(set(values.approxQuantile("raw", [k / CELLS for k in range(1, CELLS)], 0.5 / CELLS)))
    celled = Bucketizer(splits=[-math.inf, *borders, math.inf], inputCol="raw", outputCol="cell").transform(values)
    cells = celled.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("raw").alias("first"), F.max("raw").alias("last"))
    cells = sorted(cells.collect(), key=lambda c: c["cell"])
    found, offsets, g, b, lower = [], [], 0, 0, cells[0]["first"] - 1
    for cell, after in zip(cells, [*(c["first"] for c in cells[1:]), cells[-1]["last"] + 1]):
        found.append((g / good + (1 - b / bad), g + b, lower, cell["first"]))
        offsets.append((cell["cell"], g, b, after, g / good + (1 - (b + cell["bad"]) / bad)))
        g, b, lower = g + cell["good"], b + cell["bad"], cell["last"]
    found.append((g / good + (1 - b / bad), g + b, lower, lower + 1))
    least = min(found)[0]
    open_ = [o[:4] for o in offsets if o[4] <= least]
    inside = Window.partitionBy("cell").orderBy("raw")
    low, high = F.col("g") + F.sum("good").over(inside), F.col("b") + F.sum("bad").over(inside)
    starts = scored.sparkSession.createDataFrame(open_, "cell double, g long, b long, after double")
    steps = celled.join(F.broadcast(starts), "cell").select(
        (low / F.lit(good) + (1 - high / F.lit(bad))).alias("cost"), (low + high).alias("k"), "raw", F.coalesce(F.lead("raw").over(inside), "after").alias("upper")
    )
    row = steps.agg(F.min(F.struct("cost", "k", "raw", "upper")).alias("m")).first()["m"]
    cost, k, lower, upper = min([*found, *([tuple(row)] if row else [])])
    return (lower + upper) / 2, k / (good + bad)


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` in [0, 1] and ``predicted`` (1 from CUT on) of each row.

    Null and empty texts have all features 0 and are scored like any other; null
    ids and repeated rows stay; an empty table gives an empty one; only two
    columns are read.
    """
    return rated(featurise(docs, id_col, text_col=text_col), ranking, id_col)


def rated(featured: DataFrame, ranking: Ranking, id_col: str = "doc_id") -> DataFrame:
    """``score`` of rows of ``featurise``."""
    scored = featured.select(id_col, ranking.score("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

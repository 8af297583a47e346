"""Non-negative factors of a points x features table by multiplicative updates, restarts side by side.

V is about W H with W (points x parts) and H (parts x features).  A round first
updates W, row by row, then H from two small sums over all points, W'V and W'W.
The rows of W are never stored: a row follows from its point, its hashed start
and the H of all rounds so far, so every pass is a function of the points and of
small matrices, and a lost task repeats nothing but its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spiketide.operators.kmeans import FAN_IN, MODEL_BYTES, unit_hash
from spiketide.session import stage

TINY = 1e-12
ROWS = 1024


def start_rows(pid: np.ndarray, parts: int, salt: int) -> np.ndarray:
    """Start of W: numbers in (0, 1) from the id."""
    return np.stack([unit_hash(pid, salt, j) for j in range(parts)], axis=1)


def start_parts(parts: int, features: int, salt: int) -> np.ndarray:
    """Start of H."""
    return np.stack([unit_hash(np.arange(features), salt + 500_000, j) for j in range(parts)])


def replay(v: np.ndarray, w: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """W after one update with each H of the history."""
    for h in history:
        w = w * (v @ h.T) / (w @ (h @ h.T) + TINY)
    return w


class Factors(NamedTuple):
    """Of each restart: H after every round (the start first), the squared error after the last one, and the lengths of W's columns."""

    history: list[list[np.ndarray]]
    errors: list[float]
    norms: list[np.ndarray]

    @property
    def best(self) -> int:
        return int(np.argmin(self.errors))


class Factorisation:
    """Points whose vectors are non-negative and whole; others (null, NaN, negative, of another length) are left out."""

    def __init__(self, df: DataFrame, pid: str, vec: str, features: int):
        v = F.col(vec).cast("array<double>")
        good = (F.size(v) == features) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (x < 0))
        self.points = stage(df.filter(F.col(pid).isNotNull() & good).select(F.col(pid).cast("long").alias("pid"), v.alias("v")))
        self.spark, self.d = df.sparkSession, features

    def _sums(self, parts: int, salts: list[int], history: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """W'V and W'W, with W updated by the whole history, for each restart."""
        d = self.d
        size = sum(h.nbytes for hs in history for h in hs)
        if size > MODEL_BYTES:
            raise ValueError(f"a history of {size} bytes; at most {MODEL_BYTES} are broadcast")
        box = self.spark.sparkContext.broadcast((salts, history))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            salts, history = box.value
            sums = np.zeros((len(salts), parts, d + parts))
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    pid, v = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, d)
                    for r, (salt, hs) in enumerate(zip(salts, history)):
                        w = replay(v, start_rows(pid, parts, salt), hs)
                        sums[r, :, :d] += w.T @ v
                        sums[r, :, d:] += w.T @ w
            task = [TaskContext.get().partitionId()] * len(salts)
            columns = range(len(salts)), task, [s.tobytes() for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["r", "task", "sums"])

        found = self.points.mapInArrow(add, "r long, task long, sums binary")
        tasks = self.points.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            found = found.withColumn("lot", F.floor(F.col("task") / FAN_IN)).groupBy("r", "lot").applyInArrow(_added, "r long, task long, sums binary")
        totals = np.zeros((len(salts), parts, d + parts))
        for row in sorted(found.collect(), key=lambda row: row["task"]):
            totals[row["r"]] += np.frombuffer(row["sums"]).reshape(parts, d + parts)
        box.unpersist()
        return [(t[:, :d], t[:, d:]) for t in totals]

    def fit(self, parts: int, rounds: int, restarts: int) -> Factors:
        """All restarts together; a round is one pass over the points for all of them."""
        salts = [parts * 1_000 + r for r in range(restarts)]
        history = [[start_parts(parts, self.d, s)] for s in salts]
        for _ in range(rounds):
            for hs, (wv, ww) in zip(history, self._sums(parts, salts, history)):
                hs.append(hs[-1] * wv / (ww @ hs[-1] + TINY))
        # W has been updated with every H but the last, which came after it
        squared = self.points.agg(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
        errors, norms = [], []
        for hs, (wv, ww) in zip(history, self._sums(parts, salts, [hs[:-1] for hs in history])):
            errors.append(float(squared - 2 * (hs[-1] * wv).sum() + (ww * (hs[-1] @ hs[-1].T)).sum()))
            norms.append(np.sqrt(np.diag(ww)))
        return Factors(history, errors, norms)

    def parts(self, found: Factors, restart: int) -> np.ndarray:
        """H, scaled as if the columns of W had length 1."""
        return found.history[restart][-1] * found.norms[restart][:, None]

    def loadings(self, found: Factors, restart: int) -> DataFrame:
        """``pid, weights``: the row of W of every point, its columns scaled to length 1."""
        history, norm = found.history[restart][:-1], np.maximum(found.norms[restart], TINY)
        d, parts = self.d, len(norm)
        salt = parts * 1_000 + restart
        box = self.spark.sparkContext.broadcast(history)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pid, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, d)
                w = replay(v, start_rows(pid, parts, salt), box.value) / norm
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype="i4") * parts, np.ascontiguousarray(w).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(pid), lists], names=["pid", "weights"])

        return self.points.mapInArrow(rows, "pid long, weights array<double>")


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("task")
    total = np.sum([np.frombuffer(b) for b in table["sums"].to_pylist()], axis=0)
    return pa.table({"r": [table["r"][0].as_py()], "task": [table["lot"][0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

"""Readers of the binary run files: one file per job, decoded inside tasks.

File layouts (fixed values, little endian):
  *_spk.dat  int32: units, last step, count per unit, then the steps unit by unit
  *_lfp.dat  float32: populations, sampling rate, total signal, one signal per population
  dumps      float32: one row of ``units`` values per sample
  *_mua.dat  float32: bin width, start time, fast signal, slow signal
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 200_000

Decoder = Callable[[bytes], Iterator[dict[str, np.ndarray]]]


def _scan(spark: SparkSession, path: str, pattern: str, schema: str, decode: Decoder) -> DataFrame:
    """Decode every matching file; ``job_id`` comes from the ``id<number>_`` part of its name."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"id(\d+)_", 1).alias("job"), "content")
        .select(F.try_to_number("job", F.lit("9999999999")).cast("bigint").alias("job_id"), "content")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job, content in zip(pdf["job_id"], pdf["content"]):
                for cols in decode(bytes(content)):
                    n = len(next(iter(cols.values())))
                    for at in range(0, n, ROWS_PER_BATCH):
                        part = {k: v[at : at + ROWS_PER_BATCH] for k, v in cols.items()}
                        yield pd.DataFrame({"job_id": job, **part})

    return files.mapInPandas(run, f"job_id bigint, {schema}")


def read_spikes(spark: SparkSession, path: str, pattern: str = "*_spk.dat") -> DataFrame:
    """(job_id, neuron_id, step)."""

    def decode(raw: bytes):
        data = np.frombuffer(raw, "<i4")
        units = int(data[0])
        counts = data[2 : 2 + units]
        steps = data[2 + units : 2 + units + int(counts.sum())]
        yield {"neuron_id": np.repeat(np.arange(units, dtype=np.int32), counts), "step": steps}

    return _scan(spark, path, pattern, "neuron_id int, step int", decode)


def read_lfp(spark: SparkSession, path: str, pattern: str = "*_lfp.dat", pops: tuple[str, ...] = ("total", "F", "S")) -> DataFrame:
    """(job_id, pop, n, t, v): the total signal and one per population."""

    def decode(raw: bytes):
        data = np.frombuffer(raw, "<f4")
        signals, fs = int(data[0]) + 1, float(data[1])
        length = (len(data) - 2) // signals
        for k in range(signals):
            v = data[2 + k * length : 2 + (k + 1) * length]
            n = np.arange(length, dtype=np.int32)
            name = pops[k] if k < len(pops) else str(k)
            yield {"pop": np.full(length, name, dtype=object), "n": n, "t": n / fs, "v": v}

    return _scan(spark, path, pattern, "pop string, n int, t double, v float", decode)


def read_dynamics(spark: SparkSession, path: str, units: int, fs: float, pattern: str = "*.dat") -> DataFrame:
    """(job_id, n, t, neuron_id, v) of a row-per-sample dump."""

    def decode(raw: bytes):
        data = np.frombuffer(raw, "<f4")
        rows = len(data) // units
        n = np.repeat(np.arange(rows, dtype=np.int32), units)
        yield {"n": n, "t": n / fs, "neuron_id": np.tile(np.arange(units, dtype=np.int32), rows), "v": data[: rows * units]}

    return _scan(spark, path, pattern, "n int, t double, neuron_id int, v float", decode)


def read_mua(spark: SparkSession, path: str, pattern: str = "*_mua.dat") -> DataFrame:
    """(job_id, pop, n, t, v) of two equally long activity signals."""

    def decode(raw: bytes):
        data = np.frombuffer(raw, "<f4")
        dt, start = float(data[0]), float(data[1])
        length = (len(data) - 2) // 2
        n = np.arange(length, dtype=np.int32)
        for k, name in enumerate(("F", "S")):
            v = data[2 + k * length : 2 + (k + 1) * length]
            yield {"pop": np.full(length, name, dtype=object), "n": n, "t": start + n * dt, "v": v}

    return _scan(spark, path, pattern, "pop string, n int, t double, v float", decode)

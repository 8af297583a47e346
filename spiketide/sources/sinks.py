"""Writers: partitioned Parquet, and the small text files other tools read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import as_col


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("job_id",), replace: bool = False) -> None:
    """Parquet partitioned by job.  Refuses to overwrite unless asked to.

    Rows are clustered by the partition column first, with a salt so that one
    big job is written by several tasks and small jobs do not make many files.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8))
    df.repartition(*by, salt).write.mode("overwrite" if replace else "errorifexists").partitionBy(*by).parquet(path)


def write_bundle(tables: Mapping[str, DataFrame], path: str, replace: bool = False) -> None:
    """Spikes, signals and summaries of a run side by side under one folder."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", replace=replace)


def pending_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without a result yet."""
    return jobs.join(done.select("job_id").distinct(), "job_id", "left_anti")


def total_signal(df: DataFrame, keys: Sequence[str], size: str, value: str) -> DataFrame:
    """Size-weighted mean over populations."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias(value))


def downsample(df: DataFrame, pos: str, dt_ms: float, fs: float) -> DataFrame:
    """Keep every k-th sample, k = 1000 / fs / dt cut to a whole number; no anti-alias filter."""
    k = int(round(1000 / fs / dt_ms, 9))
    return df.filter(F.pmod(F.col(pos), F.lit(k)) == 0)


def param_lines(params: DataFrame, with_seed: bool = False) -> DataFrame:
    """One text line per parameter row, in the order the reader expects."""
    body = F.concat(as_col("w"), F.flatten("p"), as_col("nu"))
    if with_seed:
        body = F.concat(F.array(F.col("seed").cast("double")), body, F.array("wratio", "tdelay"))
    return params.select(F.concat_ws(",", F.transform(body, lambda x: x.cast("string"))).alias("value"))


def axis_lines(axes: DataFrame) -> DataFrame:
    """``name:v,v,...,`` lines of a control file; an axis has few values."""
    listed = axes.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v"))
    text = F.concat_ws(",", F.transform("v", lambda x: x["value"].cast("string")))
    return listed.select(F.concat(F.col("name"), F.lit(":"), text, F.lit(",")).alias("value"))


def cached_table(spark: SparkSession, folder: str, params: Mapping[str, object], compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the result stored for exactly these parameters, or compute and store it.

    The parameters are part of the path, so a change of any of them misses the cache.
    A write that did not finish leaves no success mark and is done again.
    """
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder}/{key}"
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS")
    except AnalysisException:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

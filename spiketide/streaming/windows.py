"""Window aggregations that read the same in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(df: DataFrame, length: str, step: str, time: str = "ts", value: str = "x") -> DataFrame:
    """Count, mean and population deviation per overlapping window."""
    return (
        df.groupBy(F.window(time, length, step).alias("w"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
        .select(F.unix_micros("w.start").alias("start_us"), "n", "m", "sd")
    )


def bursts(df: DataFrame, gap: str, keys: tuple[str, ...] = ("u",), time: str = "ts") -> DataFrame:
    """Sessions per key: events at most ``gap`` apart."""
    return (
        df.groupBy(*keys, F.session_window(time, gap).alias("w"))
        .agg(F.count("*").alias("events"), F.min(time).alias("a"), F.max(time).alias("b"))
        .select(*keys, F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("end_us"), "events")
    )

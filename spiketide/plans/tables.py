"""Column-pruned views of the given tables in the terms of the data model."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import floor_div, micros
from spiketide.operators.ordered import Track, balanced_width, find_hot, ordinal

HOUR = 3_600_000_000
DAY = 24 * HOUR
# fixed value: an instant at the start of a day, from which hours of day and days are counted
T0 = 1_704_067_200_000_000
# start of the first day with an event and number of days up to the last one, from the data
BASE_SQL = f"(SELECT min(epoch_us(ts)) // {DAY} * {DAY} FROM events)"
DAYS_SQL = f"(SELECT max(epoch_us(ts)) // {DAY} - min(epoch_us(ts)) // {DAY} + 1 FROM events)"


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def file_state(spark: SparkSession, path: str) -> tuple:
    """Place, bytes, files and time of the last change of a table's folder or file: another one means other data."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(at)
    return path, size.getLength(), size.getFileCount(), fs.getFileStatus(at).getModificationTime()


def row_count(spark: SparkSession, sf: str, name: str) -> int:
    """Rows of a table, read from the file footers once for each state of its files."""
    path = f"{sf}/{name}.parquet"
    return _row_count(spark, path, file_state(spark, path))


@lru_cache(maxsize=256)
def _row_count(spark: SparkSession, path: str, state: tuple) -> int:
    return spark.read.parquet(path).count()


def chunk_width(spark: SparkSession, sf: str, name: str) -> int:
    """Chunk width from the row count (footers only) or from the session."""
    set_by_user = spark.conf.get("spark.spiketide.chunkWidth", None)
    if set_by_user:
        return int(set_by_user)
    return balanced_width(row_count(spark, sf, name))


@lru_cache(maxsize=256)
def _hot_units(spark: SparkSession, sf: str, width: int, state: tuple) -> tuple[DataFrame | None, bool]:
    return find_hot(events(spark, sf).select("u"), ["u"], width)


def event_track(spark: SparkSession, sf: str) -> Track:
    width = chunk_width(spark, sf, "events")
    hot, flat = _hot_units(spark, sf, width, file_state(spark, f"{sf}/events.parquet"))
    return Track(("u",), "event_id", width, hot=hot, flat=flat)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Spike trains: unit u fires at t (microseconds) with mark and value x."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("u"),
        "event_id",
        micros("ts").alias("t"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("x"),
    )


def first_day(spark: SparkSession, sf: str) -> Column:
    """Start of the first day with an event, as a scalar subquery."""
    return events(spark, sf).agg(floor_div(F.min("t"), DAY) * DAY).scalar()


def days(spark: SparkSession, sf: str) -> Column:
    """Days from the first to the last event, both included, as a scalar subquery."""
    return events(spark, sf).agg(floor_div(F.max("t"), DAY) - floor_div(F.min("t"), DAY) + 1).scalar()


def series(spark: SparkSession, sf: str, *cols: str) -> tuple[DataFrame, Track]:
    """Sampled signal: the events of a unit numbered n = 0, 1, 2 ..."""
    tr = event_track(spark, sf)
    src = events(spark, sf).select("u", "event_id", *cols) if cols else events(spark, sf)
    return ordinal(src, tr), tr.at("n")

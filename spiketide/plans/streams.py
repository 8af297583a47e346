"""Queries: the window operators as Structured Streaming runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.plans.registry import SQL, query
from spiketide.plans.tables import table
from spiketide.streaming import runs, windows

import spiketide.plans.segments  # noqa: F401  (registers the batch forms and their SQL)

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The events as a stream and the delay of its watermark.

    With ``spark.spiketide.filesPerBatch`` the input comes in several batches in
    the order of file times, which may not be the order of events.  ``spark.spiketide.delay`` bounds how late an event
    may come and so how much state is kept; a later one stops the run with an error.  Without it no event is late.
    """
    per_batch = spark.conf.get("spark.spiketide.filesPerBatch", None)
    src = runs.event_stream(spark, f"{sf}/events.parquet", SCHEMA, int(per_batch) if per_batch else None)
    delay = spark.conf.get("spark.spiketide.delay", None)
    if not delay:
        delay = runs.whole_span(table(spark, sf, "events", "ts")) if per_batch else "1 hour"
    return _narrow(src), delay


def _narrow(src: DataFrame) -> DataFrame:
    return src.select("ts", F.col("user_id").alias("u"), F.col("value").alias("x"))


@query("sliding_summary_stream", SQL["sliding_summary"])
def sliding_summary_stream(spark: SparkSession, sf: str) -> DataFrame:
    src, delay = stream(spark, sf)
    out = windows.sliding(src.withWatermark("ts", delay), "1 day", "12 hours")
    done = runs.run_updates(out, ["start_us"])
    return done.select("start_us", "n", rounded("m", 9).alias("m"), rounded("sd", 9).alias("sd"))


@query("session_bursts_stream", SQL["session_bursts"])
def session_bursts_stream(spark: SparkSession, sf: str) -> DataFrame:
    src, delay = stream(spark, sf)
    src = src.select("ts", "u")
    end = datetime(2100, 1, 1, tzinfo=timezone.utc)
    closing = spark.createDataFrame([(end, -1)], "ts timestamp, u bigint")
    schema = "u bigint, start_us bigint, end_us bigint, events bigint"
    out = runs.run_sessions(src, closing, lambda d: windows.bursts(d, "6 hours"), schema, delay)
    return out.filter("u >= 0")

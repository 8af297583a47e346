"""Streams over a folder of files, in one batch and in many, and inputs that the first month does not bound."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spiketide import catalog
from spiketide.streaming import runs
from tests import oracle

SF = f"{oracle.ROOT}/sf0.001"
STREAMS = ("sliding_summary_stream", "session_bursts_stream")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as eight files in a folder, the latest events in the oldest file."""
    base = tmp_path_factory.mktemp("sf")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(8, "ts").write.parquet(f"{base}/events.parquet")
    files = sorted(f for f in os.listdir(base / "events.parquet") if f.endswith(".parquet"))
    for k, f in enumerate(files):
        os.utime(base / "events.parquet" / f, (10**9 - k, 10**9 - k))
    return str(base)


@pytest.mark.parametrize("per_batch", [None, 1, 3])
@pytest.mark.parametrize("name", STREAMS)
def test_folder(spark, folder, name, per_batch):
    if per_batch:
        spark.conf.set("spark.spiketide.filesPerBatch", per_batch)
    try:
        got = sorted(map(tuple, catalog.PLANS[name](spark, folder).collect()))
    finally:
        spark.conf.unset("spark.spiketide.filesPerBatch")
    want = sorted(map(tuple, catalog.PLANS[name.removesuffix("_stream")](spark, SF).collect()))
    assert got == want and got


@pytest.mark.parametrize("name", STREAMS)
def test_a_bounded_delay_keeps_all_or_fails(spark, folder, name):
    spark.conf.set("spark.spiketide.filesPerBatch", 1)
    try:
        spark.conf.set("spark.spiketide.delay", "400 days")
        got = sorted(map(tuple, catalog.PLANS[name](spark, folder).collect()))
        assert got == sorted(map(tuple, catalog.PLANS[name.removesuffix("_stream")](spark, SF).collect()))
        spark.conf.set("spark.spiketide.delay", "1 hour")  # the latest events come first
        with pytest.raises(runs.LateRows):
            catalog.PLANS[name](spark, folder).collect()
    finally:
        spark.conf.unset("spark.spiketide.filesPerBatch")
        spark.conf.unset("spark.spiketide.delay")


@pytest.mark.parametrize("name", STREAMS)
def test_no_file(spark, tmp_path, name):
    spark.createDataFrame([], "event_id bigint").write.parquet(f"{tmp_path}/other.parquet")
    with pytest.raises(Exception):
        catalog.PLANS[name](spark, str(tmp_path)).collect()


SPANNED = "firing_rate chi_sync run_summary motif_proportion mua_smooth sliding_summary".split()


@pytest.fixture(scope="module")
def moved(spark, tmp_path_factory):
    """The events 45 days later, and some of them 20 days after that."""
    base = tmp_path_factory.mktemp("later")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    days = F.when(F.col("event_id") % 3 == 0, 65).otherwise(45)
    ev.withColumn("ts", F.timestamp_add("DAY", days, F.col("ts")).cast(ev.schema["ts"].dataType)).coalesce(1).write.parquet(f"{base}/raw")
    part = next(f for f in os.listdir(base / "raw") if f.endswith(".parquet"))
    os.symlink(base / "raw" / part, base / "events.parquet")
    return str(base)


@pytest.mark.parametrize("name", SPANNED)
def test_later_events(spark, moved, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{moved}/events.parquet'")
    assert oracle.compare(spark, con, name, moved) == []

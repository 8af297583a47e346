"""Bounded runs of streaming queries whose whole result can be read afterwards."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.session import shared_dir


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream; ``ts`` is cast because watermarks need an instant.

    Without ``files_per_batch`` everything there is makes one micro-batch.  A path without a file is an error.
    """
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if not files:
        raise FileNotFoundError(f"no Parquet file in {path}")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, name = path.rstrip("/").rsplit("/", 1)
    if len(files) == 1 and files[0].endswith(f"/{name}") and not files[0].endswith(f"/{name}/{name}"):
        reader, path = reader.option("pathGlobFilter", name), folder  # a stream starts from a folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def whole_span(table: DataFrame, time: str = "ts") -> str:
    """A watermark delay under which no row of a table is late, in whatever order its files come."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = table.agg(F.min(t), F.max(t)).first()
    return f"{((high or 0) - (low or 0)) // 1_000_000 + 1} seconds"


class LateRows(ValueError):
    """Rows came after the watermark had passed them, so the result lacks them."""


PROGRESS_KEY = "spark.sql.streaming.numRecentProgressUpdates"
BATCHES = 1_000_000  # batches whose dropped rows are remembered


def _drain(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if late:
        raise LateRows(f"{late} late rows; a longer delay (spark.spiketide.delay) keeps them")


def run_updates(out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run in update mode to the end of the input and return the last value of every key.

    State is dropped behind the watermark, each batch appends what changed,
    and the newest entry per key is the result.
    """
    spark = out.sparkSession
    spark.conf.set(PROGRESS_KEY, BATCHES)
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{base}/log/batch={number}")

    _drain(
        out.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start()
    )
    log = spark.read.schema(f"{_ddl(out)}, batch bigint").parquet(f"{base}/log")
    rest = [c for c in out.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def run_sessions(events: DataFrame, closing: DataFrame, plan: Callable[[DataFrame], DataFrame], schema: str, delay: str) -> DataFrame:
    """Run an append-mode session query to the end and close what is still open.

    Append mode holds back sessions newer than the watermark.  After the data,
    one ``closing`` row far in the future moves the watermark past all of them;
    it comes through a second folder, so it can only arrive last.
    """
    spark = events.sparkSession
    spark.conf.set(PROGRESS_KEY, BATCHES)
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    spark.createDataFrame([], closing.schema).write.parquet(f"{base}/closing")
    late = spark.readStream.schema(closing.schema).parquet(f"{base}/closing")

    def start():
        out = plan(events.unionByName(late).withWatermark("ts", delay))
        return (
            out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )

    _drain(start())
    closing.coalesce(1).write.mode("append").parquet(f"{base}/closing")
    _drain(start())
    return spark.read.schema(schema).parquet(f"{base}/out")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)

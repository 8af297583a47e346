"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}  # folders made for local applications, by application


def local_session(cores: str | int = "*", app: str = "spiketide", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees, as the cluster names it.

    Only a local master may fall back to a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spiketide-", dir="/tmp")
    return _own_dirs[app]


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Two-pass operators read their input twice.  Stacked on each other they
    would recompute the bottom of the plan 2, 4, 8 ... times; a written stage
    keeps that at two column-pruned scans and survives the loss of executors.
    The size of a written table is known exactly, so a join with it is
    broadcast by Spark's own threshold and never by guess.
    """
    return staged(df)[0]


def staged(df: DataFrame, **options: str | int) -> tuple[DataFrame, str]:
    """A stage and its folder, for those that drop it with ``unstage`` once it is of no more use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

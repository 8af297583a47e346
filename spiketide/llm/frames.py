"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SPACE = r"\x20\x09-\x0D"  # fixed values: the white space that separates words


def load(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def as_schema(ddl: str) -> StructType:
    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return kind


BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_BYTES at most, so that texts of any length pass in bounded memory.

    The limit is a setting of the session; a smaller one that is already there stays.
    """
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH_KEY).rstrip("b"))
    if now > BATCH_BYTES:
        conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def map_rows(
    df: DataFrame,
    ddl: str,
    start: Callable[[], Callable[..., Iterable[tuple]]],
    rows: int = 256,
) -> DataFrame:
    """Arrow batches through a row function that ``start`` makes once in each task.

    The function gets the columns of ``df`` in order and yields any number of
    output rows.  Output goes out every ``rows`` rows, so that memory follows a
    few rows and never a partition.
    """
    schema = as_schema(ddl)
    arrow = to_arrow_schema(schema)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = start(), []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(fn(*row))
                    if len(out) >= rows:
                        yield pack(out)
                        out = []
        if out:
            yield pack(out)

    return map_batches(df, run, schema)


class Shared:
    """A broadcast value of proven size and what a Python worker makes of it, once for all its tasks.

    A worker keeps the last made value only: what another job or operator left is dropped first.
    """

    _made: tuple[str, object] = ("", None)

    def __init__(self, spark: SparkSession, value: tuple, build: Callable[..., object]):
        self.key, self.box, self.build = uuid.uuid4().hex, spark.sparkContext.broadcast(value), build

    def get(self) -> object:
        if Shared._made[0] != self.key:
            Shared._made = ("", None)
            Shared._made = (self.key, self.build(*self.box.value))
        return Shared._made[1]

"""Smoothing of two-axis maps that are stored one cell a row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 256  # cells of a block along either axis


def _mirrored(at: str, size: int, radius: int) -> Column:
    """Where a cell stands, itself and mirrored over the borders it is near to (d c b a | a b c d | d c b a)."""
    p = F.col(at)
    return F.array_compact(F.array(p, F.when(p < radius, -1 - p), F.when(p >= size - radius, 2 * size - 1 - p)))


def _blocks(at: Column, size: int, radius: int, block: int) -> Column:
    """Blocks that a cell at a place lies in or within ``radius`` of."""
    first = F.greatest(F.floor((at - radius) / block), F.lit(0).cast("bigint"))
    last = F.least(F.floor((at + radius) / block), F.lit((size - 1) // block).cast("bigint"))
    return F.filter(F.sequence(first, F.greatest(first, last)), lambda b: b <= last)


def smooth_map(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str, shape: tuple[int, int], taps: Sequence[float], block: int = BLOCK) -> DataFrame:
    """``keys, row, col, smooth``: each map convolved with ``taps`` along both axes, borders mirrored.

    Maps have ``shape`` cells; cells that are not stored, or null or NaN, are
    0, cells outside are ignored, repeated cells add up.  Result cells of 0 are
    left out.  A block borrows the cells around it, so a map of any size is
    the work of many tasks and a block is all that a task holds.
    """
    keys, radius = list(keys), len(taps) // 2
    rows, cols = shape
    if len(taps) % 2 == 0 or radius > min(rows, cols, block):
        raise ValueError("an odd number of taps, no wider than the map and a block")
    v = F.col(value).cast("double")
    inside = F.col(row).between(0, rows - 1) & F.col(col).between(0, cols - 1) & v.isNotNull() & ~F.isnan(v)
    cells = df.filter(inside).select(*keys, F.col(row).cast("bigint").alias("_r"), F.col(col).cast("bigint").alias("_c"), v.alias("_v"))
    cells = cells.withColumn("_r", F.explode(_mirrored("_r", rows, radius))).withColumn("_c", F.explode(_mirrored("_c", cols, radius)))
    dealt = cells.withColumn("_i", F.explode(_blocks(F.col("_r"), rows, radius, block))).withColumn("_j", F.explode(_blocks(F.col("_c"), cols, radius, block)))
    kinds = {f.name: f.dataType for f in df.schema}
    schema = pa.schema([*[(k, to_arrow_type(kinds[k])) for k in keys], ("row", pa.int64()), ("col", pa.int64()), ("smooth", pa.float64())])
    weights = [float(t) for t in taps]

    def convolve(table: pa.Table) -> pa.Table:
        top, left = table["_i"][0].as_py() * block, table["_j"][0].as_py() * block
        height, width = min(block, rows - top), min(block, cols - left)
        x = np.zeros((height + 2 * radius, width + 2 * radius))
        np.add.at(x, (table["_r"].to_numpy() - top + radius, table["_c"].to_numpy() - left + radius), table["_v"].to_numpy())
        down = sum(w * x[k : k + height] for k, w in enumerate(weights))
        both = sum(w * down[:, k : k + width] for k, w in enumerate(weights))
        r, c = np.nonzero(both)
        head = [pa.array([table[k][0].as_py()] * len(r), schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*head, pa.array(r + top), pa.array(c + left), pa.array(both[r, c])], schema=schema)

    ddl = ", ".join([*[f"`{k}` {kinds[k].simpleString()}" for k in keys], "row long", "col long", "smooth double"])
    return dealt.groupBy(*keys, "_i", "_j").applyInArrow(convolve, ddl)

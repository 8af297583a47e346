"""Order-aware building blocks that never put a hot key into one task.

A key may hold a third of all rows, so a plain ``Window.partitionBy(key)``
would sort that third in a single task.  Keys with more rows than ``width`` are
hot: they are cut into chunks of ``width`` positions, windows run inside
(key, chunk), and what crosses a border is carried through a table with one row
per hot (key, chunk), aggregated before it is shuffled.  There can be at most
rows / width hot keys, so their list is small enough to be broadcast; with
``width`` near the square root of the row count chunks and chunks per key are
both small.  All other keys fit a task and need no second pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import floor_div
from spiketide.session import stage

CHUNK = "_chunk"
HOT = "_hot"


@dataclass(frozen=True)
class Track:
    """Ordering of a long table: keys, whole-number position, chunk width.

    ``tie`` names columns that order rows of equal position.  ``hot`` lists the
    keys to cut (a table of some of the key columns); without it every key is
    cut.  ``flat`` says that no key is hot.
    """

    keys: tuple[str, ...]
    pos: str
    width: int
    tie: tuple[str, ...] = ()
    hot: DataFrame | None = None
    flat: bool = False

    def at(self, pos: str, width: int | None = None, tie: tuple[str, ...] = ()) -> "Track":
        return replace(self, pos=pos, width=width or self.width, tie=tie)

    def within(self, *keys: str) -> "Track":
        """The same ordering inside further key columns."""
        return replace(self, keys=(*self.keys, *keys))

    @property
    def parts(self) -> list[str]:
        """Columns that windows are partitioned by."""
        return list(self.keys) if self.flat else [*self.keys, CHUNK]

    @property
    def chunk(self) -> Column:
        return floor_div(self.pos, self.width)

    def order(self, backwards: bool = False) -> list[Column]:
        cols = [F.col(c) for c in (self.pos, *self.tie)]
        return [c.desc() if backwards else c.asc() for c in cols]

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the chunk of every row, 0 for keys that are not hot, and whether the key is hot."""
        if self.flat:
            return df
        if self.hot is None:
            return df.withColumn(HOT, F.lit(True)).withColumn(CHUNK, self.chunk)
        marked = df.join(self.hot.withColumn(HOT, F.lit(True)), self.hot.columns, "left")
        return marked.select(
            *df.columns,
            F.coalesce(F.col(HOT), F.lit(False)).alias(HOT),
            F.when(F.col(HOT), self.chunk).otherwise(F.lit(0).cast("bigint")).alias(CHUNK),
        )


def balanced_width(rows: int, floor: int = 64) -> int:
    """Chunk width that keeps rows per chunk and chunks per key both small."""
    return max(floor, 8 * math.isqrt(max(rows, 1)))


def find_hot(df: DataFrame, keys: Sequence[str], width: int) -> tuple[DataFrame | None, bool]:
    """(hot keys, flat) for a Track: the keys with more than ``width`` rows.

    The list is written, so that Spark knows its size when it plans joins.
    """
    hot = stage(df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > width).select(*keys))
    return (None, True) if hot.isEmpty() else (hot, False)


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(
    df: DataFrame,
    track: Track,
    aggs: Mapping[str, tuple[str, Column]],
    backwards: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sum/max/min columns along each key, from the start or the end."""
    keys = list(track.keys)
    cut = track.cut(df)
    local_w = (
        W.partitionBy(*track.parts)
        .orderBy(*track.order(backwards))
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    local = cut.select("*", *[_COMBINE[k][0](c).over(local_w).alias(f"_in_{n}") for n, (k, c) in aggs.items()])
    if track.flat:
        both = local.select("*", *[F.lit(None).alias(f"_out_{n}") for n in aggs])
    else:
        carry_w = (
            W.partitionBy(*keys)
            .orderBy(F.col(CHUNK).desc() if backwards else F.col(CHUNK).asc())
            .rowsBetween(W.unboundedPreceding, -1)
        )
        totals = cut.filter(HOT).groupBy(*keys, CHUNK).agg(
            *[_COMBINE[k][0](c).alias(f"_all_{n}") for n, (k, c) in aggs.items()]
        )
        carried = totals.select(
            *keys, CHUNK, *[_COMBINE[k][0](f"_all_{n}").over(carry_w).alias(f"_out_{n}") for n, (k, _) in aggs.items()]
        )
        both = local.join(carried, [*keys, CHUNK], "left")
    return both.select(
        *df.columns,
        *[_COMBINE[k][1](F.col(f"_in_{n}"), F.col(f"_out_{n}")).alias(n) for n, (k, _) in aggs.items()],
    )


def ordinal(df: DataFrame, track: Track, name: str = "n") -> DataFrame:
    """Dense position 0, 1, 2 ... of every row within its key."""
    out = running(df, track, {name: ("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name) - 1)


def neighbours(
    df: DataFrame, track: Track, prev: Sequence[str] = (), following: Sequence[str] = ()
) -> DataFrame:
    """Add prev_<c> and next_<c>: values of the adjacent row of the same key."""
    keys = list(track.keys)
    local_w = W.partitionBy(*track.parts).orderBy(*track.order())
    carry_w = W.partitionBy(*keys).orderBy(CHUNK)
    rank = F.struct(track.pos, *track.tie)
    cut = track.cut(df)
    local, ends, carried, out = [], [], [], []
    for tag, cols, pick, move in (
        ("prev", prev, F.max_by, F.lag),
        ("next", following, F.min_by, F.lead),
    ):
        if not cols:
            continue
        row = F.struct(*cols)
        local.append(move(row).over(local_w).alias(f"_in_{tag}"))
        ends.append(pick(row, rank).alias(f"_end_{tag}"))
        carried.append(move(f"_end_{tag}").over(carry_w).alias(f"_out_{tag}"))
        both = F.col(f"_in_{tag}") if track.flat else F.coalesce(F.col(f"_in_{tag}"), F.col(f"_out_{tag}"))
        out += [both[c].alias(f"{tag}_{c}") for c in cols]
    rows = cut.select("*", *local)
    if not track.flat:
        borders = cut.filter(HOT).groupBy(*keys, CHUNK).agg(*ends).select(*keys, CHUNK, *carried)
        rows = rows.join(borders, [*keys, CHUNK], "left")
    return rows.select(*df.columns, *out)


def halo(df: DataFrame, track: Track, behind: int = 0, ahead: int = 0) -> tuple[DataFrame, W]:
    """Copy rows near a chunk border into the next chunk, for bounded frames.

    Needs dense positions.  Returns the table with ``_own`` (true for the row
    itself, false for a copy) and the window to use; keep ``_own`` rows after.
    """
    if track.flat:
        return df.withColumn("_own", F.lit(True)), W.partitionBy(*track.keys).orderBy(*track.order())
    if max(behind, ahead) > track.width:
        raise ValueError("chunk width is smaller than the frame")
    c = track.chunk
    at = F.pmod(F.col(track.pos), F.lit(track.width).cast("bigint"))
    homes = [F.col(CHUNK)]
    if behind:
        homes.append(F.when(F.col(HOT) & (at >= track.width - behind), c + 1))
    if ahead:
        homes.append(F.when(F.col(HOT) & (at < ahead), c - 1))
    cut = track.cut(df)
    wide = cut.select(*df.columns, F.col(CHUNK).alias("_home"), F.explode(F.array_compact(F.array(*homes))).alias(CHUNK))
    wide = wide.withColumn("_own", F.col(CHUNK) == F.col("_home")).drop("_home")
    return wide, W.partitionBy(*track.parts).orderBy(*track.order())


def own(df: DataFrame) -> DataFrame:
    """Drop the border copies made by ``halo``."""
    return df.filter("_own").drop("_own", CHUNK)


def dense_rank_of_all(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Place 0, 1, 2 ... of every row among all rows of a table, by columns that tell the rows apart.

    Rows are dealt by ranges, so no task sees more than its range; places
    follow from one count for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    base = stage(sizes.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base")))
    return placed.join(base, "_part").withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")

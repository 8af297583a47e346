"""Counts of two signals when one is rotated against the other, for many rounds.

A state is a byte and a chunk of samples one value, so a unit that fits a task
is turned there for all rounds and only counts leave it.  Of a unit with many
chunks each round sends the bytes of one signal to the chunks of the other
they come to lie on; the other signal is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spiketide.operators.ordered import CHUNK, HOT, Track
from spiketide.session import stage

MOST_CELLS = 1 << 25  # rounds x cells that a task counts
STEP = 4096  # positions that are counted at a time


class _Cells:
    """Cells of the joint tables: states from 0 to ``states`` - 1, either (x, y) alone or (lag, dir, now, then, src)."""

    def __init__(self, states: int, lags: int, rounds: int):
        self.s, self.lags, self.rounds = states, lags, rounds
        self.each = 2 * lags * states**3 if lags else states**2
        if self.each * rounds > MOST_CELLS:
            raise ValueError(f"{states} states, {lags} lags and {rounds} rounds are more than {MOST_CELLS} cells")

    def add(self, counts: np.ndarray, x: np.ndarray, y: np.ndarray, own: int, left: int) -> None:
        """Count ``own`` positions; x is rounds x positions, y positions, ``left`` samples of the unit from the first on."""
        s, shift = self.s, np.arange(self.rounds)[:, None] * self.each
        if not self.lags:
            counts += np.bincount((x[:, :own] * s + y[:own] + shift).ravel(), minlength=len(counts))
            return
        for lag in range(1, self.lags + 1):
            n = min(own, left - lag)
            if n > 0:
                x0, x1, y0, y1 = x[:, :n], x[:, lag : lag + n], y[:n], y[lag : lag + n]
                for d, code in enumerate(((y1 * s + y0) * s + x0, (x1 * s + x0) * s + y0)):
                    counts += np.bincount((code + ((lag - 1) * 2 + d) * s**3 + shift).ravel(), minlength=len(counts))

    def rows(self, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(at // self.each), pa.array(at % self.each), pa.array(counts[at])], names=["round", "cell", "n"])

    def named(self, counts: DataFrame) -> DataFrame:
        """Cells as columns."""
        s, cell = self.s, "cell"
        total = counts.groupBy("round", cell).agg(F.sum("n").alias("n"))
        if not self.lags:
            return total.select("round", F.expr(f"cell div {s}").alias("x"), F.expr(f"cell % {s}").alias("y"), "n")
        return total.select(
            "round",
            F.expr(f"cell div {2 * s**3} + 1").alias("lag"),
            F.expr(f"cell div {s**3} % 2").alias("dir"),
            F.expr(f"cell div {s**2} % {s}").alias("now"),
            F.expr(f"cell div {s} % {s}").alias("then"),
            F.expr(f"cell % {s}").alias("src"),
            "n",
        )


def _packed(df: DataFrame, track: Track, x: str, y: str) -> DataFrame:
    """``keys, chunk, hot, xs, ys``: the states of a chunk as bytes."""
    keys, pos = list(track.keys), track.pos
    cut = track.cut(df.select(*keys, pos, F.col(x).cast("smallint").alias("_x"), F.col(y).cast("smallint").alias("_y")))
    if track.flat:
        cut = cut.withColumn(CHUNK, F.lit(0).cast("bigint")).withColumn(HOT, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    schema = pa.schema([*[(k, to_arrow_type(kinds[k])) for k in keys], ("chunk", pa.int64()), ("hot", pa.bool_()), ("xs", pa.binary()), ("ys", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        head = [table[c][0].as_py() for c in [*keys, CHUNK, HOT]]
        states = [table[c].to_numpy().astype("u1").tobytes() for c in ("_x", "_y")]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*head, *states], schema)], schema=schema)

    ddl = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", chunk long, hot boolean, xs binary, ys binary"
    return stage(cut.groupBy(*keys, CHUNK).applyInArrow(pack, ddl))


def _turned(xs: np.ndarray, offsets: np.ndarray, low: int, n: int) -> np.ndarray:
    """Positions low .. low + n - 1 of a whole signal in every round."""
    return xs[(np.arange(low, low + n) + offsets[:, None]) % len(xs)]


def rotated_counts(df: DataFrame, track: Track, x: str, y: str, lags: int, rounds: int) -> DataFrame:
    """Joint counts with x rotated against y within every unit, for each round.

    With ``lags`` the columns of ``lagged_joint`` and round; with 0 lags
    ``round, x, y, n``.  The rotation of a unit is a hash of unit and round.
    States are whole numbers from 0 to 254, and few: rounds x cells are bounded.
    Positions must be dense.
    """
    keys = list(track.keys)
    low, high, gaps = df.agg(F.min(F.least(x, y)), F.max(F.greatest(x, y)), F.count_if(F.col(x).isNull() | F.col(y).isNull())).first()
    if gaps or (low is not None and (low < 0 or high > 254)):
        raise ValueError("states are whole numbers from 0 to 254")
    cells = _Cells(int(high or 0) + 1, lags, rounds)
    packed = _packed(df, track, x, y)
    length = packed.groupBy(*keys).agg(F.sum(F.octet_length("xs")).alias("len"))
    named = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])

    def offset(r):
        digits = F.substring(F.md5(F.concat(named, F.lit(":"), r.cast("string"))), 1, 8)
        return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.col("len"))

    turned = packed.join(length.select(*keys, "len", F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), offset).alias("offsets")), keys)
    counts = turned.filter(~F.col("hot")).select("xs", "ys", "offsets").mapInArrow(_count_whole(cells), "round long, cell long, n long")
    if not track.flat:
        counts = counts.union(_hot_counts(turned.filter("hot"), packed.filter("hot"), keys, cells, track.width))
    return cells.named(counts)


def _count_whole(cells: _Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells.rounds * cells.each, "i8")
        for batch in batches:
            for xs, ys, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = (np.frombuffer(b, "u1").astype("i8") for b in (xs, ys))
                o = np.array(offsets)
                for low in range(0, len(x), STEP):
                    n = min(STEP + cells.lags, len(x) - low)
                    cells.add(counts, _turned(x, o, low, n), y[low : low + n], min(STEP, n), len(x) - low)
        yield cells.rows(counts)

    return run


def _hot_counts(turned: DataFrame, packed: DataFrame, keys: list[str], cells: _Cells, width: int) -> DataFrame:
    """Counts of units with several chunks: pieces of x meet the chunk of y, and its first lags beyond, where they come to lie."""
    kinds = {f.name: f.dataType for f in packed.schema}
    types = [(k, to_arrow_type(kinds[k])) for k in keys]
    key_ddl = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys)
    sent = pa.schema([*types, ("at", pa.int64()), ("len", pa.int64()), ("round", pa.int32()), ("start", pa.int64()), ("bytes", pa.binary())])
    lags = cells.lags

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                *head, chunk, length, xs, offsets = row
                out = []
                for r, o in enumerate(offsets):
                    first = (chunk * width - o) % length
                    for a, skip, n in ((first, 0, min(len(xs), length - first)), (0, length - first, len(xs) - (length - first))):
                        for c in range(max(0, (a - lags) // width), (a + n - 1) // width + 1) if n > 0 else ():
                            low, high = max(a, c * width), min(a + n, (c + 1) * width + lags)
                            if low < high:
                                out.append((*head, c, length, r, low, xs[skip + low - a : skip + high - a]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), sent)], schema=sent)

    pieces = turned.select(*keys, "chunk", "len", "xs", "offsets").mapInArrow(send, f"{key_ddl}, at long, len long, round int, start long, bytes binary")
    own = [f"_key{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own)]
    whole = packed.select(*named, F.col("chunk").alias("_at"), F.lit(0).alias("_part"), F.col("ys").alias("_ys"))
    head = packed.filter("chunk > 0").select(*named, (F.col("chunk") - 1).alias("_at"), F.lit(1).alias("_part"), F.substring("ys", 1, lags).alias("_ys"))

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        c, length = x["at"][0].as_py(), x["len"][0].as_py()
        parts = dict(zip(y["_part"].to_pylist(), y["_ys"].to_pylist()))
        ys = np.frombuffer(parts[0] + parts.get(1, b""), "u1").astype("i8")
        turned = np.zeros((cells.rounds, len(ys)), "i8")
        for r, start, states in zip(x["round"].to_pylist(), x["start"].to_pylist(), x["bytes"].to_pylist()):
            low = start - c * width
            turned[r, low : low + len(states)] = np.frombuffer(states, "u1")
        counts = np.zeros(cells.rounds * cells.each, "i8")
        for low in range(0, len(parts[0]), STEP):
            n = min(STEP, len(parts[0]) - low)
            cells.add(counts, turned[:, low : low + n + lags], ys[low : low + n + lags], n, length - c * width - low)
        return pa.Table.from_batches([cells.rows(counts)])

    both = whole.unionByName(head)
    return pieces.groupBy(*keys, "at").cogroup(both.groupBy(*own, "_at")).applyInArrow(count, "round long, cell long, n long")

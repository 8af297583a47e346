"""Peaks, plateaus among them, and their prominence, for units of any length.

The prominence of a peak needs the nearest higher sample on either side and the
lowest one on the way there.  Inside a chunk of a unit one monotone stack finds
both.  What lies beyond a border is found in two steps: every chunk knows the
highest and lowest value of all chunks of its unit, which names the chunk where
the way ends, and that chunk answers from the stack that it shows to the border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spiketide.operators import segments
from spiketide.operators.ordered import CHUNK, Track, neighbours
from spiketide.session import stage

LEFT, RIGHT = 0, 1
LOT = 4096  # samples whose questions to one chunk travel as one row


def _ways(values: list[float], near: list[int]) -> Iterator[tuple[int, float, int, bool]]:
    """For each run in order, looking back: (index of it, lowest value before a higher run, where, whether one was met).

    ``near`` is the sample of each run that is met first.  The stack holds runs
    of falling height, each with the lowest value between it and the next one.
    """
    stack: list[tuple[float, float, int]] = []
    for k, v in enumerate(values):
        low, base = v, near[k]
        while stack and stack[-1][0] <= v:
            _, below, at = stack.pop()
            if below < low:
                low, base = below, at
        yield k, low, base, bool(stack)
        stack.append((v, low, base))


def _shown(values: list[float], near: list[int]) -> tuple[list[float], list[float], list[int]]:
    """The stack after the last run: heights falling towards it, and the lowest value from behind each to the end."""
    heights: list[float] = []
    lows: list[float] = []
    bases: list[int] = []
    low, base = float("inf"), -1
    for v, at in zip(reversed(values), reversed(near)):
        if not heights or v > heights[-1]:
            heights.append(v)
            lows.append(low)
            bases.append(base)
        if v < low:
            low, base = v, at
    return heights, lows, bases


def _beyond(chunk: int, side: int, value: float, low: float, base: int, others: dict) -> tuple[float, int, int | None]:
    """Lowest value and its place over whole chunks, up to the chunk that has a higher value (None: the end of the unit)."""
    numbers = others["chunk"]
    here = numbers.index(chunk)
    way = range(here - 1, -1, -1) if side == LEFT else range(here + 1, len(numbers))
    for k in way:
        if others["high"][k] > value:
            return low, base, numbers[k]
        if others["low"][k] < low:
            low, base = others["low"][k], others["last" if side == LEFT else "first"][k]
    return low, base, None


def peaks(df: DataFrame, track: Track, value: str) -> DataFrame:
    """``keys, n, left, right, value, prominence, left_base, right_base`` of every peak.

    A peak is a run of equal values with lower ones on both sides; ``n`` is its
    middle sample (the earlier of two), ``left`` and ``right`` its first and
    last.  The ends of a unit are no peaks.  A base is the lowest sample between
    the peak and the nearest higher one, or the end of the unit; of equal ones
    the nearest to the peak.  Positions must be dense; null and NaN values cut a
    unit into pieces that know nothing of each other.
    """
    keys = list(track.keys)
    v = F.col(value).cast("double")
    whole = v.isNotNull() & ~F.isnan(v)
    runs = segments.runs(df.withColumn("_v", F.when(whole, v)), track, "_v").select(*keys, "start", "end", F.col("state").alias("v"))
    by_start = track.at("start")
    sided = neighbours(runs, by_start, prev=["v"], following=["v"])
    top = (F.col("v") > F.col("prev_v")) & (F.col("v") > F.col("next_v"))
    cut = by_start.cut(sided.withColumn("top", F.coalesce(top, F.lit(False))))
    cut = cut if CHUNK in cut.columns else cut.withColumn(CHUNK, F.lit(0).cast("bigint"))
    cut = stage(cut.select(*keys, CHUNK, "start", (F.col("end") - 1).alias("stop"), "v", "top"))
    infinite = F.lit(float("inf"))
    some = F.col("v").isNotNull()
    summary = cut.groupBy(*keys, CHUNK).agg(
        F.max(F.coalesce("v", infinite)).alias("high"),
        F.min(F.when(some, F.struct("v", "start"))).alias("_first"),
        F.min(F.when(some, F.struct("v", (-F.col("stop")).alias("stop")))).alias("_last"),
    )
    figures = F.struct(F.col(CHUNK).alias("chunk"), "high", F.coalesce("_first.v", infinite).alias("low"), F.col("_first.start").alias("first"), (-F.col("_last.stop")).alias("last"))
    unit = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(figures)).alias("others"))
    own_keys = [f"_key{i}" for i in range(len(keys))]
    spread = unit.select(*[F.col(k).alias(o) for k, o in zip(keys, own_keys)], F.explode("others.chunk").alias("_at"), "others")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    n = len(keys)

    names = [*keys, "start", "stop", "side", "value", "low", "base", "target"]
    arrow = pa.schema([*[(k, to_arrow_type(cut.schema[k].dataType)) for k in keys], ("start", pa.int64()), ("stop", pa.int64()), ("side", pa.int32()), ("value", pa.float64()), ("low", pa.float64()), ("base", pa.int64()), ("target", pa.int64())])

    def rows_of(key: list, rows: list[tuple]) -> pa.Table:
        columns = [[x] * len(rows) for x in key] + (list(map(list, zip(*rows))) if rows else [[]] * (len(names) - n))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def local(one: pa.Table, rest: pa.Table) -> pa.Table:
        one = one.sort_by("start")
        values = [float("inf") if x is None else x for x in one["v"].to_pylist()]
        start, stop, top = (one[c].to_pylist() for c in ("start", "stop", "top"))
        chunk = one[CHUNK][0].as_py()
        around = rest["others"][0].as_py()
        others = {c: [o[c] for o in around] for c in ("chunk", "high", "low", "first", "last")}
        rows = []
        back = list(_ways(values, stop))
        ahead = list(_ways(values[::-1], start[::-1]))[::-1]
        for k, is_top in enumerate(top):
            if is_top:
                for side, (_, low, base, met) in ((LEFT, back[k]), (RIGHT, ahead[k])):
                    target = None
                    if not met:
                        low, base, target = _beyond(chunk, side, values[k], low, base, others)
                    rows.append((start[k], stop[k], side, values[k], low, base, target))
        return rows_of([one[k][0].as_py() for k in keys], rows)

    ddl = f"{key_ddl}, start long, stop long, side int, value double, low double, base long, target long"
    ways = stage(cut.groupBy(*keys, CHUNK).cogroup(spread.groupBy(*own_keys, "_at")).applyInArrow(local, ddl))
    asked = ways.filter("target is not null")
    if not track.flat and not asked.isEmpty():
        ways = ways.filter("target is null").unionByName(_answered(cut, asked, keys, key_ddl, arrow, ddl))
    return _both_sides(ways, keys)


def _answered(cut: DataFrame, asked: DataFrame, keys: list[str], key_ddl: str, arrow: pa.Schema, ddl: str) -> DataFrame:
    """Ways that end in another chunk: one row of questions for each pair of chunks meets the stack its target shows."""
    shown_types = [*[(k, arrow.field(k).type) for k in keys], (CHUNK, pa.int64()), ("side", pa.int32()), ("heights", pa.list_(pa.float64())), ("lows", pa.list_(pa.float64())), ("bases", pa.list_(pa.int64()))]
    shown_schema = pa.schema(shown_types)

    def show(one: pa.Table) -> pa.Table:
        one = one.sort_by("start")
        values = [float("inf") if x is None else x for x in one["v"].to_pylist()]
        head = [one[k][0].as_py() for k in [*keys, CHUNK]]
        rows = [
            (*head, LEFT, *_shown(values, one["stop"].to_pylist())),
            (*head, RIGHT, *_shown(values[::-1], one["start"].to_pylist()[::-1])),
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows)), shown_schema)], schema=shown_schema)

    wanted = asked.select(*keys, F.col("target").alias(CHUNK)).distinct()
    shown = cut.join(wanted, [*keys, CHUNK], "left_semi").groupBy(*keys, CHUNK).applyInArrow(
        show, f"{key_ddl}, {CHUNK} long, side int, heights array<double>, lows array<double>, bases array<long>"
    )
    asks = asked.withColumnRenamed("target", CHUNK).groupBy(*keys, CHUNK, "side", F.floor(F.col("start") / LOT).alias("_lot")).agg(
        F.collect_list(F.struct("start", "stop", "value", "low", "base")).alias("asks")
    )
    met = asks.join(shown, [*keys, CHUNK, "side"]).select(*keys, "side", "asks", "heights", "lows", "bases")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                heights = np.array(r["heights"])
                for a in r["asks"]:
                    k = int(np.searchsorted(heights, a["value"], "right"))
                    low, base = a["low"], a["base"]
                    if r["lows"][k] < low:
                        low, base = r["lows"][k], r["bases"][k]
                    rows.append((*(r[x] for x in keys), a["start"], a["stop"], r["side"], a["value"], low, base, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return met.mapInArrow(answer, ddl)


def _both_sides(ways: DataFrame, keys: list[str]) -> DataFrame:
    left, right = (F.max(F.when(F.col("side") == s, F.struct("low", "base"))) for s in (LEFT, RIGHT))
    both = ways.groupBy(*keys, "start", "stop", "value").agg(left.alias("l"), right.alias("r"))
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    return both.select(
        *keys,
        middle.cast("bigint").alias("n"),
        F.col("start").alias("left"),
        F.col("stop").alias("right"),
        "value",
        (F.col("value") - F.greatest("l.low", "r.low")).alias("prominence"),
        F.col("l.base").alias("left_base"),
        F.col("r.base").alias("right_base"),
    )

"""Runs, gaps, bursts, peaks: segmentation of ordered signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import rank_hash
from spiketide.operators.ordered import Track, halo, neighbours, own, running
from spiketide.session import stage


def _close(edges: DataFrame, track: Track, first: str, last: str) -> DataFrame:
    """Turn rows flagged as first and/or last of a run into one row per run.

    ``first``/``last`` name the position columns of an edge row's own extent.
    The row after an opening edge that is not also closing is its closing edge.
    """
    paired = neighbours(edges, track, following=[last])
    return paired.filter("_opens").withColumn(
        "end", F.when(F.col("_closes"), F.col(last)).otherwise(F.col(f"next_{last}"))
    )


def runs(df: DataFrame, track: Track, state: str) -> DataFrame:
    """Run-length encoding: (keys, start, end, state) with half-open [start, end)."""
    wide, w = halo(df.select(*track.keys, track.pos, state), track, behind=1, ahead=1)
    s = F.col(state)
    edges = own(
        wide.select(
            "*",
            (~F.lag(s).over(w).eqNullSafe(s)).alias("_opens"),
            (~F.lead(s).over(w).eqNullSafe(s)).alias("_closes"),
        )
    ).filter("_opens OR _closes")
    edges = edges.withColumn("_stop", F.col(track.pos) + 1)
    return _close(stage(edges), track, track.pos, "_stop").select(
        *track.keys, F.col(track.pos).alias("start"), "end", F.col(state).alias("state")
    )


def merge_adjacent(intervals: DataFrame, track: Track) -> DataFrame:
    """Join touching intervals of equal state into one."""
    tr = track.at("start")
    near = neighbours(stage(intervals), tr, prev=["end", "state"], following=["start", "state"])
    edges = near.select(
        *track.keys, "start", "end", "state",
        (~(F.col("prev_state").eqNullSafe(F.col("state")) & F.col("prev_end").eqNullSafe(F.col("start")))).alias("_opens"),
        (~(F.col("next_state").eqNullSafe(F.col("state")) & F.col("next_start").eqNullSafe(F.col("end")))).alias("_closes"),
    ).filter("_opens OR _closes").withColumnRenamed("end", "_stop")
    return _close(edges, tr, "start", "_stop").select(*track.keys, "start", "end", "state")


def drop_short_rest(intervals: DataFrame, min_len: int) -> DataFrame:
    """Drop intervals of state 0 that are shorter than ``min_len``; others stay."""
    return intervals.filter((F.col("state") != 0) | (F.col("end") - F.col("start") >= min_len))


def fill_gaps(df: DataFrame, track: Track, flags: Sequence[str], longest: int) -> DataFrame:
    """Set runs of false up to ``longest`` rows long that a true row follows.

    A gap at the very start counts, a gap at the end does not.  Such a gap is
    decided by at most ``longest`` rows on either side.
    """
    wide, w = halo(df, track, behind=longest, ahead=longest)
    pos = F.col(track.pos)
    before, after = w.rowsBetween(-longest, -1), w.rowsBetween(1, longest)
    filled = []
    for f in flags:
        at = F.when(F.col(f), pos)
        left = F.coalesce(F.max(at).over(before), F.lit(-1))
        right = F.min(at).over(after)
        filled.append((F.col(f) | F.coalesce(right - left - 1 <= longest, F.lit(False))).alias(f))
    others = [c for c in wide.columns if c not in flags]
    return own(wide.select(*others, *filled)).select(*df.columns)


def state_word(flags: Sequence[Column]) -> Column:
    """Pack boolean tracks into one number, the first track in bit 0."""
    word = F.lit(0).cast("bigint")
    for i, f in enumerate(flags):
        word = word + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return word


def absorb_short(intervals: DataFrame, track: Track, min_len: int) -> DataFrame:
    """Absorb groups of short non-zero runs into a neighbour that contains them.

    A group is a maximal sequence of short runs of non-zero state.  It takes
    the state of the run after it when that is non-zero and holds every bit of
    the group, else of the run before it, else the union of its own states.
    Since groups never touch each other, all of them are decided at once.
    """
    tr = track.at("start")
    short = (F.col("state") != 0) & (F.col("end") - F.col("start") < min_len)
    near = neighbours(intervals.withColumn("short", short), tr, prev=["state", "short"], following=["state", "short"])
    opens = F.col("short") & ~F.coalesce(F.col("prev_short"), F.lit(False))
    closes = F.col("short") & ~F.coalesce(F.col("next_short"), F.lit(False))
    marked = stage(near.withColumn("_opens", opens).withColumn("_closes", closes))
    grouped = running(marked.filter("short"), tr, {"group": ("max", F.when(F.col("_opens"), F.col("start")))})
    bits = F.bit_or("state")
    merged = grouped.groupBy(*track.keys, "group").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        bits.alias("own"),
        F.max(F.when(F.col("_opens"), F.col("prev_state"))).alias("before"),
        F.max(F.when(F.col("_closes"), F.col("next_state"))).alias("after"),
    )

    def holds(c: str) -> Column:
        return F.coalesce((F.col(c) != 0) & (F.col(c).bitwiseOR(F.col("own")) == F.col(c)), F.lit(False))

    state = F.when(holds("after"), F.col("after")).when(holds("before"), F.col("before")).otherwise(F.col("own"))
    kept = marked.filter(~F.col("short")).select(*track.keys, "start", "end", "state")
    return merge_adjacent(kept.unionByName(merged.select(*track.keys, "start", "end", state.alias("state"))), track)


def stab(points: DataFrame, intervals: DataFrame, track: Track) -> DataFrame:
    """Add the interval (start, end, state) of disjoint intervals that holds each point.

    Points and interval starts are put on one axis; the last start at or
    before a point is the only candidate, so nothing is joined pair by pair.
    Points outside every interval get NULL.
    """
    keys, pos = list(track.keys), track.pos
    extra = [c for c in points.columns if c not in (*keys, pos)]
    both = points.select(*keys, pos, F.struct(*extra).alias("_row") if extra else F.lit(True).alias("_row"), F.lit(1).alias("_what"))
    starts = intervals.select(
        *keys, F.col("start").alias(pos), F.lit(0).alias("_what"), F.struct("start", "end", "state").alias("_iv")
    )
    axis = both.unionByName(starts, allowMissingColumns=True)
    found = running(axis, track.at(pos, tie=("_what",)), {"_hit": ("max", F.col("_iv"))}).filter("_what = 1")
    inside = F.col(pos) < F.col("_hit.end")
    cols = [F.col(f"_row.{c}").alias(c) for c in extra]
    return found.select(*keys, pos, *cols, *[F.when(inside, F.col(f"_hit.{c}")).alias(c) for c in ("start", "end", "state")])


def sessions(df: DataFrame, track: Track, time: str, gap: int) -> DataFrame:
    """Bursts of events at most ``gap`` apart: (keys, start, end, events).

    Events are first grouped inside each chunk; the partial sessions of a key,
    which cannot outnumber time span / gap plus the chunks, are then joined.
    """
    keys = list(track.keys)
    w = W.partitionBy(*track.parts).orderBy(*track.order())
    t = F.col(time)
    cut = track.cut(df.select(*keys, track.pos, time))
    new = F.coalesce(t - F.lag(t).over(w) > gap, F.lit(True)).cast("int")
    part = (
        cut.withColumn("_new", new)
        .withColumn("_id", F.sum("_new").over(w))
        .groupBy(*track.parts, "_id")
        .agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("events"))
    )
    if track.flat:
        return part.drop("_id")
    kw = W.partitionBy(*keys).orderBy("start")
    far = F.coalesce(F.col("start") - F.lag("end").over(kw) > gap, F.lit(True)).cast("int")
    return (
        part.withColumn("_new", far)
        .withColumn("_id", F.sum("_new").over(kw))
        .groupBy(*keys, "_id")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events"))
        .drop("_id")
    )


def local_peaks(df: DataFrame, track: Track, value: str) -> DataFrame:
    """Rows strictly above both neighbours (the two ends have only one and never count)."""
    wide, w = halo(df, track, behind=1, ahead=1)
    v = F.col(value)
    return own(wide.withColumn("_peak", (v > F.lag(v).over(w)) & (v > F.lead(v).over(w)))).filter("_peak").drop("_peak")


def upward_crossings(df: DataFrame, track: Track, value: str, level: float) -> DataFrame:
    """Rows above the level whose predecessor is below it."""
    wide, w = halo(df, track, behind=1)
    v = F.col(value)
    return own(wide.withColumn("_up", (F.lag(v).over(w) < level) & (v > level))).filter("_up").drop("_up")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key; Spark keeps k rows per task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def two_peaks(peaks: DataFrame, keys: Sequence[str], pos: str, value: str, apart: int = 5, share: float = 1 / 3) -> DataFrame:
    """Largest peak and the largest one at least ``apart`` away from it.

    The second falls back to the first when it is missing or below ``share``.
    """
    best = F.max_by(F.struct(pos, value), F.struct(F.col(value), -F.col(pos)))
    first = peaks.groupBy(*keys).agg(best.alias("_1"))
    far = peaks.join(first, list(keys)).filter(F.abs(F.col(pos) - F.col(f"_1.{pos}")) >= apart)
    second = far.groupBy(*keys).agg(best.alias("_2"))
    ok = F.coalesce(F.col(f"_2.{value}") >= F.col(f"_1.{value}") * share, F.lit(False))
    return first.join(second, list(keys), "left").select(
        *keys,
        F.col(f"_1.{pos}").alias("n0"),
        F.col(f"_1.{value}").alias("v0"),
        F.when(ok, F.col(f"_2.{pos}")).otherwise(F.col(f"_1.{pos}")).alias("n1"),
    )


def smooth(df: DataFrame, track: Track, value: str, taps: Sequence[float], length: DataFrame | None = None) -> DataFrame:
    """Weighted moving sum.  With ``length`` (keys, length) the ends are mirrored
    (d c b a | a b c d | d c b a); without it rows with an incomplete frame drop out.

    Mirroring assumes a series at least as long as the kernel's radius.
    """
    r = len(taps) // 2
    keys, pos = list(track.keys), track.pos
    df = df.select(*keys, pos, value)
    if length is not None:
        p = F.col(pos)
        both = df.join(length, keys)
        at = F.array_compact(
            F.array(p, F.when(p < r, -1 - p), F.when(p >= F.col("length") - r, 2 * F.col("length") - 1 - p))
        )
        df = both.select(*keys, "length", value, F.explode(at).alias(pos))
    wide, w = halo(df, track, behind=r, ahead=r)
    v = F.col(value)
    acc = F.lit(0.0)
    for j, tap in zip(range(-r, r + 1), taps):
        acc = acc + F.lit(float(tap)) * (F.lag(v, -j).over(w) if j < 0 else F.lead(v, j).over(w))
    out = own(wide.withColumn("smooth", acc)).filter("smooth IS NOT NULL")
    if length is not None:
        out = out.filter((F.col(pos) >= 0) & (F.col(pos) < F.col("length")))
    return out.select(*keys, pos, value, "smooth")


def cut_chunks(points: DataFrame, intervals: DataFrame, track: Track, lead_in: int = 0) -> DataFrame:
    """Samples of each interval with up to ``lead_in`` samples before it: (keys, start, state, k, values).

    ``k`` counts from the interval's start and is negative in the lead-in.  A
    sample serves its own interval and, when close enough, the next one, so
    ``lead_in`` must not exceed the shortest interval.  Nothing is padded.
    """
    keys, pos = list(track.keys), track.pos
    inside = stab(points, intervals, track).filter("start IS NOT NULL").drop("end")
    out = inside
    if lead_in:
        extra = [c for c in points.columns if c not in (*keys, pos)]
        rows = points.select(*keys, pos, F.struct(*extra).alias("_row"), F.lit(0).alias("_what"))
        starts = intervals.select(*keys, F.col("start").alias(pos), F.lit(1).alias("_what"), F.struct("start", "state").alias("_iv"))
        axis = rows.unionByName(starts, allowMissingColumns=True)
        ahead = running(axis, track.at(pos, tie=("_what",)), {"_next": ("min", F.col("_iv"))}, backwards=True, inclusive=True)
        near = ahead.filter("_what = 0").filter(
            (F.col("_next.start") > F.col(pos)) & (F.col("_next.start") - F.col(pos) <= lead_in)
        )
        before = near.select(*keys, pos, *[F.col(f"_row.{c}").alias(c) for c in extra], "_next.start", "_next.state")
        out = inside.unionByName(before)
    return out.withColumn("k", F.col(pos) - F.col("start"))


def resample(df: DataFrame, track: Track, time: str, value: str, step: int) -> DataFrame:
    """Linear interpolation onto whole multiples of ``step`` between the first and last sample of a key."""
    near = neighbours(df, track, following=[time, value]).filter(F.col(f"next_{time}").isNotNull())
    t, end = F.col(time), F.col(f"next_{time}")
    first = t + F.pmod(-t, F.lit(step).cast("bigint"))
    at = near.filter(first < end).select("*", F.explode(F.sequence(first, end - 1, F.lit(step).cast("bigint"))).alias("_at"))
    v = F.col(value) + (F.col(f"next_{value}") - F.col(value)) * (F.col("_at") - t) / (end - t)
    return at.select(*track.keys, F.col("_at").alias(time), v.alias(value))


def random_windows(df: DataFrame, keys: Sequence[str], length: int, seed: int) -> DataFrame:
    """(keys, n0): start of one window of ``length`` rows per key, the same on every run; shorter keys have none."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_len")).filter(F.col("_len") >= length).withColumn("_seed", F.lit(seed))
    return size.select(*keys, F.pmod(rank_hash(*keys, "_seed"), F.col("_len") - (length - 1)).alias("n0"))

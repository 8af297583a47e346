"""What reaches a receiver and goes on to its targets, and what does not: triggers, edges, drawn controls.

Units that answer are asked by time, whoever asks: an ask and an answer meet on
the axis of the unit that answers, so that axis is what is cut when a unit is
asked by many or answers often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import rank_hash
from spiketide.operators.aligned import joint_table, presence
from spiketide.operators.ordered import Track, balanced_width, ordinal
from spiketide.session import stage


def sampled_targets(pairs: DataFrame, edges: DataFrame, most: int, keep: Column, seed: int) -> DataFrame:
    """``trigger, receiver, slot, unit``: up to ``most`` targets of each pair's receiver, drawn by hash.

    ``pairs`` has (trigger, receiver), ``edges`` (pre, post); ``keep`` is a
    condition on receiver and post.  Tasks keep ``most`` rows of a pair before
    they shuffle, so a hub passes on few of its edges; the join splits a hub by
    Spark's own measures, as each pair needs only its edges.  Repeated edges are
    one; a pair whose receiver has no such target has no row.
    """
    found = pairs.join(edges.distinct(), F.col("receiver") == F.col("pre")).filter(keep)
    drawn = found.withColumn("_seed", F.lit(seed)).withColumn("_h", rank_hash("trigger", "receiver", "post", "_seed"))
    order = W.partitionBy("trigger", "receiver").orderBy("_h", "post")
    top = drawn.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= most)
    return top.select("trigger", "receiver", "slot", F.col("post").alias("unit"))


def answer_track(asks: DataFrame, answers: DataFrame, bins: int, width: int | None = None) -> Track:
    """Axis (unit, time) cut where asks and answers of a unit together exceed ``width`` rows.

    A chunk of time holds about ``width`` rows of all units together, hence
    fewer of any one unit.
    """
    load = asks.select("unit", F.lit(bins).alias("n"), "t").unionByName(answers.select("unit", F.lit(1).alias("n"), "t"))
    sums = stage(load.groupBy("unit").agg(F.sum("n").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")))
    rows, low, high = sums.agg(F.sum("n"), F.min("low"), F.max("high")).first()
    rows = rows or 1
    width = width or balanced_width(rows)
    hot = stage(sums.filter(F.col("n") > width).select("unit"))
    span = max(1, ((high or 0) - (low or 0)) * width // rows)
    return Track(("unit",), "t", span, flat=True) if hot.isEmpty() else Track(("unit",), "t", span, hot=hot)


def answered(asks: DataFrame, answers: DataFrame, edges: Sequence[int], width: int | None = None) -> DataFrame:
    """``ask, b, hit``: does the asked unit answer in [t + edge, t + next edge) of the ask?

    ``asks`` has (unit, t, ask), ``answers`` (unit, t); a unit that never
    answers has misses only.
    """
    track = answer_track(asks, answers, len(edges) - 1, width)
    return presence(asks, answers.select("unit", "t", F.lit("hit").alias("mark")), track, edges, ["hit"], "ask").select("ask", "b", "hit")


def masks(hits: DataFrame) -> DataFrame:
    """``ask, mask``: one bit for each bin with an answer."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").cast("int"))
    return hits.groupBy("ask").agg(F.bit_or(F.when(F.col("hit"), one).otherwise(F.lit(0).cast("bigint"))).alias("mask"))


def route_counts(triggers: DataFrame, targets: DataFrame, answers: DataFrame, edges: Sequence[int], by: Sequence[str], width: int | None = None) -> DataFrame:
    """2 x 2 presence counts of receiver and target for every pair of bins: (by, b1, b2, s1, s2, n).

    ``triggers`` has (event, t, trigger, receiver, by); every target of the pair
    counts once for each trigger event.  Presence is a mask of bits for each
    ask, equal pairs of masks are counted before bins are looked at.
    """
    bins = len(edges) - 1
    if bins > 63:
        raise ValueError("a presence mask has 63 bins at most")
    first = triggers.select(F.col("receiver").alias("unit"), "t", F.struct("event", F.lit(0).alias("slot")).alias("ask"))
    onward = triggers.join(targets, ["trigger", "receiver"])
    second = onward.select("unit", "t", F.struct("event", "slot").alias("ask"))
    found = stage(masks(answered(first.unionByName(second), answers, edges, width)).select("ask.event", "ask.slot", "mask"))
    one = found.filter("slot = 0").select("event", F.col("mask").alias("m1"))
    two = found.filter("slot > 0").select("event", F.col("mask").alias("m2"))
    named = triggers.select("event", *by).join(one, "event").join(two, "event")
    return joint_table(named.groupBy(*by, "m1", "m2").agg(F.count("*").alias("k")), bins, by)


def drawn_controls(triggers: DataFrame, pool: DataFrame, side: str, seed: int, width: int = 1 << 16) -> DataFrame:
    """Trigger events with ``control``: a member of the pool of their ``side``, drawn afresh for every event.

    ``pool`` has (side, unit), the units that may be drawn; whoever is selected
    must be left out of it before.  Members are ranked in their side, and an
    event asks for one rank, so the join is by equality and spreads over the
    pool.  Events of a side without members get none and drop out.
    """
    members = pool.distinct()
    ranked = ordinal(members, Track((side,), "unit", width), "_k")
    sizes = stage(members.groupBy(side).agg(F.count("*").alias("_m")))
    asks = triggers.join(sizes, side).withColumn("_seed", F.lit(seed)).withColumn("_k", F.pmod(rank_hash("event", "_seed"), F.col("_m")))
    return asks.join(ranked.withColumnRenamed("unit", "control"), [side, "_k"]).drop("_k", "_m", "_seed")

"""Event-aligned joins: what follows a trigger, bin by bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spiketide.operators.ordered import Track, running
from spiketide.session import stage


def presence(
    triggers: DataFrame, responses: DataFrame, track: Track, edges: Sequence[int], marks: Sequence[str], trigger_id: str
) -> DataFrame:
    """Per (trigger, bin): does a response of each mark fall into [t + edge, t + next edge)?

    ``responses`` has (keys, pos, mark).  A trigger sends one probe per bin and
    each probe looks up the next response at or after its own left edge, so a
    busy key costs triggers x bins + responses, never triggers x responses.
    """
    keys, pos = list(track.keys), track.pos
    bins = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("b"), F.lit(a).cast("bigint").alias("lo"), F.lit(b - a).cast("bigint").alias("w"))
          for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    )
    probes = triggers.select(*keys, pos, trigger_id, F.explode(bins).alias("_b")).select(
        *keys, (F.col(pos) + F.col("_b.lo")).alias(pos), trigger_id, F.col("_b.b").alias("b"), F.col("_b.w").alias("_w"),
        F.lit(0).alias("_tie"),
    )
    seen = responses.select(*keys, pos, "mark", F.lit(1).alias("_tie"))
    axis = probes.unionByName(seen, allowMissingColumns=True)
    nxt = {f"_n_{m}": ("min", F.when(F.col("mark") == m, F.col(pos))) for m in marks}
    found = running(axis, track.at(pos, tie=("_tie",)), nxt, backwards=True).filter("_tie = 0")
    hit = [F.coalesce(F.col(f"_n_{m}") < F.col(pos) + F.col("_w"), F.lit(False)).alias(m) for m in marks]
    return found.select(*keys, trigger_id, "b", *hit)


def response_curve(hits: DataFrame, mark: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of triggers with a response, per bin (every trigger sends one probe per bin)."""
    return hits.groupBy(*by, "b").agg(
        F.count_if(mark).alias("hits"), F.count("*").alias("triggers"), (F.count_if(mark) / F.count("*")).alias("prob")
    )


def joint_presence(hits: DataFrame, first: str, second: str, trigger_keys: Sequence[str], bins: int) -> DataFrame:
    """2 x 2 presence counts of two responses for every pair of bins.

    Presence is packed into one bit mask per trigger and response, equal masks
    are counted once, and the pair table comes from conditional sums.
    """
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").cast("int"))

    def mask(c: str) -> Column:
        return F.bit_or(F.when(F.col(c), one).otherwise(F.lit(0)))

    if bins > 64:
        raise ValueError("a presence mask has 64 bins at most")
    masks = hits.groupBy(*trigger_keys).agg(mask(first).alias("m1"), mask(second).alias("m2"))
    return joint_table(masks.groupBy("m1", "m2").agg(F.count("*").alias("k")), bins)


def joint_table(kinds: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``by, b1, b2, s1, s2, n`` from counts ``k`` of presence masks (by, m1, m2)."""
    spread = kinds.select(*by, "k", "m2", "m1", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b1")).select(
        *by, "k", "m2", "b1", F.getbit("m1", F.col("b1")).cast("bigint").alias("s1")
    )
    bit = [F.sum(F.when(F.getbit("m2", F.lit(j)) == 1, F.col("k")).otherwise(F.lit(0))).alias(f"_{j}") for j in range(bins)]
    wide = spread.groupBy(*by, "b1", "s1").agg(F.sum("k").alias("_k"), *bit)
    cells = F.array(*[F.struct(F.lit(j).alias("b2"), F.col(f"_{j}").alias("on")) for j in range(bins)])
    states = F.array(
        F.struct(F.lit(1).cast("bigint").alias("s2"), F.col("c.on").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("s2"), (F.col("_k") - F.col("c.on")).alias("n")),
    )
    return (
        wide.select(*by, "b1", "s1", "_k", F.explode(cells).alias("c"))
        .select(*by, "b1", "s1", "c.b2", F.explode(states).alias("s"))
        .select(*by, F.col("b1").cast("bigint").alias("b1"), F.col("b2").cast("bigint").alias("b2"), "s1", "s.s2", "s.n")
        .filter("n > 0")
    )


def scatter(unit: str | Column, seed: int = 0) -> Column:
    """Order units pseudo-randomly by an odd multiplier modulo 2^32; ids that agree modulo 2^32 tie."""
    u = F.col(unit) if isinstance(unit, str) else unit
    return F.pmod(F.pmod(u.cast("bigint"), F.lit(4294967296)).cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(20,0)") + F.lit(seed * 97531).cast("decimal(20,0)"), F.lit(4294967296).cast("decimal(20,0)")).cast("bigint")


def control_partner(units: DataFrame, unit: str, pop: str, slots: int = 4096) -> DataFrame:
    """A pseudo-random unit of the other population for every unit: (unit, partner).

    Units stand on a ring ordered by ``scatter``; a unit takes the next member
    of the other population, the last ones wrap around.
    """
    u = units.select(F.col(unit).alias("_u"), F.col(pop).alias("_p"), scatter(unit).alias("_h"))
    sides = u.agg(F.sort_array(F.collect_set("_p"))).scalar()  # two populations
    asks = u.select("_u", "_h", F.explode(F.array_except(sides, F.array("_p"))).alias("_side"), F.lit(0).alias("_tie"))
    gives = u.select("_h", F.col("_p").alias("_side"), F.struct("_h", "_u").alias("_cand"), F.lit(1).alias("_tie"))
    track = Track(("_side",), "_h", 4294967296 // slots, tie=("_tie",))
    ring = running(
        asks.unionByName(gives, allowMissingColumns=True), track, {"_next": ("min", F.col("_cand"))}, backwards=True
    ).filter("_tie = 0")
    first = gives.groupBy("_side").agg(F.min("_cand").alias("_first"))
    return ring.join(first, "_side").select(
        F.col("_u").alias(unit), F.coalesce("_next._u", "_first._u").alias("partner")
    )


def propagate(spikes: DataFrame, edges: DataFrame, step: str = "step") -> DataFrame:
    """Deliver every spike along its out-edges: (post, step + delay, summed weight).

    ``spikes`` (pre, step, amplitude) are merged per (pre, step) before the join.
    """
    merged = spikes.groupBy("pre", step).agg(F.sum("amplitude").alias("a"))
    return (
        merged.join(edges, "pre")
        .groupBy("post", (F.col(step) + F.col("delay")).alias(step))
        .agg(F.sum(F.col("w") * F.col("a")).alias("input"))
    )

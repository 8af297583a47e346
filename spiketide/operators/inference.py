"""Exact quantiles, interval and permutation tests, resampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spiketide.functions.columns import rank_hash, total
from spiketide.operators.ordered import Track, running
from spiketide.session import stage


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    direct_rows: int = 1_000_000,
    spread: float = 0.001,
    cells: int = 4096,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (keys, p, q).

    When the largest group is known to be small the built-in aggregate does
    it.  Otherwise a sketch only proposes brackets around the wanted ranks;
    exact counts per bracket say where each rank really lies, a second count
    over equal sub-cells narrows that down, and just the rows of the hit
    sub-cells are ordered.  A poor sketch costs time, never correctness.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).alias("v")).filter("v IS NOT NULL")
    sizes = d.groupBy(*keys).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= direct_rows:
        q = F.percentile("v", F.array(*[F.lit(float(p)) for p in probs]))
        pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("_q"))
        flat = d.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.explode(pairs).alias("z"))
        return flat.select(*keys, F.col("z")["p"].alias("p"), F.col("z")["_q"].alias("q"))

    cuts = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-spread, spread)})
    sketch = stage(
        d.groupBy(*keys).agg(
            F.count("*").alias("n"), F.percentile_approx("v", F.array(*[F.lit(c) for c in cuts]), 10_000).alias("cuts")
        )
    )
    cell = total([(F.col("v") > F.get("cuts", F.lit(i))).cast("int") for i in range(len(cuts))])
    in_cell = d.join(sketch.select(*keys, "cuts"), keys).select(*keys, "v", cell.alias("cell"))

    def placed(counts: DataFrame, ranks: DataFrame, within: list[str], slot: str) -> DataFrame:
        """Which slot holds each rank, and the rank left inside it."""
        w = W.partitionBy(*within).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
        below = counts.withColumn("_b", F.coalesce(F.sum("n").over(w), F.lit(0)))
        hit = ranks.join(below, within).filter((F.col("r") >= F.col("_b")) & (F.col("r") < F.col("_b") + F.col("n")))
        return hit.withColumn("r", F.col("r") - F.col("_b"))

    h = (F.col("n") - 1) * F.col("p")
    wanted = sketch.select(*keys, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).select(
        *keys, "p", (h - F.floor(h)).alias("frac"), F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("rank")
    )
    ranks = wanted.select(*keys, "rank", F.col("rank").alias("r")).distinct()
    counts = in_cell.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    first = stage(placed(counts, ranks, keys, "cell").select(*keys, "rank", "r", "cell", "lo", "hi"))

    bounds = first.select(*keys, "cell", "lo", "hi").distinct()
    sub = F.least(F.lit(cells - 1), F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(5e-324)) * cells))
    in_sub = in_cell.join(bounds, [*keys, "cell"]).select(*keys, "cell", "v", sub.alias("sub"))
    second = stage(
        placed(in_sub.groupBy(*keys, "cell", "sub").agg(F.count("*").alias("n")), first.drop("lo", "hi"), [*keys, "cell"], "sub").select(
            *keys, "cell", "rank", "r", "sub"
        )
    )
    left = in_sub.join(second.select(*keys, "cell", "sub").distinct(), [*keys, "cell", "sub"], "left_semi")
    values = left.groupBy(*keys, "cell", "sub", "v").agg(F.count("*").alias("n"))
    found = placed(values, second, [*keys, "cell", "sub"], "v").select(*keys, "rank", "v")
    ends = wanted.join(found, [*keys, "rank"])
    low, high = F.min("v"), F.max("v")
    return ends.groupBy(*keys, "p").agg((low + (high - low) * F.max("frac")).alias("q"))


def wide_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], **kw) -> DataFrame:
    """One column per named quantile."""
    q = exact_quantiles(df, keys, value, list(dict.fromkeys(probs.values())), **kw)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in probs.items()])


def interval_overlap(df: DataFrame, keys: Sequence[str], sample: str, a: str, b: str, value: str, alpha: float = 0.05, **kw) -> DataFrame:
    """Per group: are the [alpha, 1 - alpha] intervals of samples a and b disjoint?"""
    q = wide_quantiles(df, [*keys, sample], value, {"lo": alpha, "hi": 1 - alpha}, **kw)
    picked = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col(sample) == s, F.col(c))).alias(f"{c}_{t}") for t, s in (("a", a), ("b", b)) for c in ("lo", "hi")]
    )
    return picked.withColumn("differs", (F.col("lo_a") > F.col("hi_b")) | (F.col("hi_a") < F.col("lo_b")))


PRIME = 2_147_483_647
CHUNK = 4_096  # rows that are hashed for all rounds at once
BUCKETS = 1_024  # of hashes, at most
SLAB = 20  # rounds that travel together
HELD_BYTES = 64 << 20  # counts and sums of several groups that a task holds


def split_factor(r: int) -> int:
    """Multiplier of round ``r``: a hash of its number, never a multiple of the prime."""
    return int(hashlib.md5(f"split:{r}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1


def permutation_test(
    df: DataFrame, keys: Sequence[str], row_id: str, value: str, in_first: str, rounds: int, lo: float = 0.01, hi: float = 0.99
) -> DataFrame:
    """Difference of means against ``rounds`` random splits of the same sizes.

    A split gives the first sample's size to the rows of smallest hash.  A row
    is hashed once; a round multiplies that modulo a prime with a factor of its own.  Rows travel in chunks, and a
    task counts and sums a chunk in hash buckets for all rounds, so what is shuffled is the size of the
    buckets; then only the rows of the bucket that the border falls into are sent on and sorted.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(
        F.count_if(in_first).alias("nx"),
        F.count("*").alias("n"),
        F.sum(value).alias("s"),
        (F.avg(F.when(F.col(in_first), F.col(value))) - F.avg(F.when(~F.col(in_first), F.col(value)))).alias("dm"),
    )
    sizes = stage(sizes.withColumn("_gid", F.monotonically_increasing_id()))
    chunks = stage(_chunks(df, sizes, keys, row_id, value))
    factors = np.array([split_factor(r) for r in range(rounds)], "i8")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for gid, shift, nx, base, v, _ in _unpacked(batches):
            if (gid, shift, nx) not in held:
                if held and len(held) * rounds * BUCKETS * 16 >= HELD_BYTES:
                    yield _slabs(held)
                    held = {}
                held[gid, shift, nx] = np.zeros((rounds, (PRIME >> shift) + 1), "i8"), np.zeros((rounds, (PRIME >> shift) + 1))
            counts, sums = held[gid, shift, nx]
            some = np.where(v.is_valid(), v.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            for low in range(0, rounds, SLAB):
                many = counts.shape[1]
                cells = (_hashes(base, factors[low : low + SLAB]) >> shift) + np.arange(len(factors[low : low + SLAB]))[:, None] * many
                size = cells.shape[0] * many
                counts[low : low + SLAB] += np.bincount(cells.ravel(), minlength=size).reshape(-1, many)
                sums[low : low + SLAB] += np.bincount(cells.ravel(), np.tile(some, cells.shape[0]), minlength=size).reshape(-1, many)
        if held:
            yield _slabs(held)

    def border(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        nx, many = table["nx"][0].as_py(), (PRIME >> table["shift"][0].as_py()) + 1
        counts = np.sum([np.frombuffer(b, "i8") for b in table["counts"].to_pylist()], axis=0).reshape(-1, many)
        sums = np.sum([np.frombuffer(b) for b in table["sums"].to_pylist()], axis=0).reshape(-1, many)
        upto = np.cumsum(counts, axis=1)
        at = (upto < nx).sum(axis=1)
        take = [nx - int(u[k] - c[k]) for u, c, k in zip(upto, counts, at)]
        below = [float(x[:k].sum()) for x, k in zip(sums, at)]
        first = table["slab"][0].as_py() * SLAB
        head = [[table["_gid"][0].as_py()] * len(at), range(first, first + len(at)), at, below, take]
        return pa.Table.from_arrays([pa.array(x) for x in head], names=["_gid", "round", "bucket", "sum_below", "take"])

    slabs = chunks.mapInArrow(count, "_gid long, shift long, nx long, slab long, task long, counts binary, sums binary")
    borders = stage(slabs.filter("nx > 0").groupBy("_gid", "slab").applyInArrow(border, "_gid long, round long, bucket long, sum_below double, take long"))
    packed = borders.groupBy("_gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "bucket"))), lambda x: x["bucket"]).alias("buckets"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(6)
            for i, (gid, shift, _, base, v, ids) in enumerate(_unpacked([batch])):
                buckets = np.array(wanted[i].as_py())
                for low in range(0, rounds, SLAB):
                    h = _hashes(base, factors[low : low + SLAB])
                    r, at = np.nonzero(h >> shift == buckets[low : low + SLAB, None])
                    parts = pa.array(np.full(len(r), gid)), pa.array(r + low), pa.array(h[r, at]), ids.take(pa.array(at)), v.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(list(parts), names=["_gid", "round", "h", "id", "v"])

    kind = df.schema[row_id].dataType.simpleString()
    near = chunks.join(packed, "_gid").select(*chunks.columns, "buckets").mapInArrow(pick, f"_gid long, round long, h long, id {kind}, v double")
    bw = W.partitionBy("_gid", "round").orderBy("h", "id")
    edge = (
        near.join(borders, ["_gid", "round"])
        .withColumn("k", F.row_number().over(bw))
        .filter("k <= take")
        .groupBy("_gid", "round")
        .agg((F.sum("v") + F.max("sum_below")).alias("sx"))
    )
    dm = F.col("sx") / F.col("nx") - (F.col("s") - F.col("sx")) / (F.col("n") - F.col("nx"))
    shuffled = edge.join(sizes, "_gid").select(*keys, dm.alias("d"))
    q = wide_quantiles(shuffled, keys, "d", {"lo": lo, "hi": hi})
    return sizes.join(q, keys).select(*keys, "dm", "lo", "hi", ((F.col("lo") > F.col("dm")) | (F.col("hi") < F.col("dm"))).alias("differs"))


def _chunks(df: DataFrame, sizes: DataFrame, keys: Sequence[str], row_id: str, value: str) -> DataFrame:
    """Rows of a group in chunks of about CHUNK: hashes, values and ids; a bucket is a hash shifted, about as many as the root of the group's size."""
    bits = F.least(F.lit(BUCKETS.bit_length() - 1), F.ceil(F.log2("n") / 2))
    groups = sizes.select(*keys, "_gid", "nx", (31 - bits).cast("long").alias("shift"), F.ceil(F.col("n") / CHUNK).alias("_many"))
    # spread the rows first: each one is about to be hashed for every round
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = rank_hash(row_id)
    one = F.struct(F.pmod(base, F.lit(PRIME)).alias("base"), F.col(value).cast("double").alias("v"), F.col(row_id).alias("id"))
    rows = df.join(groups, keys).select("_gid", "shift", "nx", F.pmod(F.xxhash64(base, value), "_many").alias("_chunk"), one.alias("one"))
    lists = rows.repartition(tasks, "_gid", "_chunk").groupBy("_gid", "_chunk", "shift", "nx").agg(F.collect_list("one").alias("x"))
    return lists.select("_gid", "shift", "nx", F.col("x.base").alias("base"), F.col("x.v").alias("v"), F.col("x.id").alias("id"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, pa.Array, pa.Array]]:
    for batch in batches:
        heads = zip(*(batch.column(k).to_pylist() for k in range(3)))
        for i, head in enumerate(heads):
            base, v, ids = (batch.column(k)[i].values for k in (3, 4, 5))
            yield *head, base.to_numpy(), v, ids


def _hashes(base: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """base x factor modulo PRIME, rounds x rows; 2^31 is 1 there, so high bits are added to low ones."""
    x = factors[:, None] * base
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    x[x >= PRIME] -= PRIME
    return x


def _slabs(held: dict[tuple, tuple]) -> pa.RecordBatch:
    """Counts and sums of some rounds at a time as packed rows."""
    task = TaskContext.get().partitionId()
    rows = [
        (*head, low // SLAB, task, counts[low : low + SLAB].tobytes(), sums[low : low + SLAB].tobytes())
        for head, (counts, sums) in held.items()
        for low in range(0, len(counts), SLAB)
    ]
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["_gid", "shift", "nx", "slab", "task", "counts", "sums"])


def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, mean: float = 0.0) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.try_divide(F.avg(value) - F.lit(mean), F.stddev_samp(value) / F.sqrt(F.count(value))).alias("t"),
    ).withColumn("dof", F.col("n") - 1)


def two_sample_t(df: DataFrame, keys: Sequence[str], value: str, in_first: str) -> DataFrame:
    """Pooled-variance t statistic of the first sample against the rest."""
    a, b = F.when(F.col(in_first), F.col(value)), F.when(~F.col(in_first), F.col(value))
    s = df.groupBy(*keys).agg(
        F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
    )
    dof = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb"))))
    return s.select(*keys, "na", "nb", t.alias("t"), dof.alias("dof"))


@F.pandas_udf(DoubleType())
def t_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided p-value of Student's t (incomplete beta by its continued fraction)."""
    from math import lgamma

    for t, dof in batches:
        t, v = t.to_numpy(float), dof.to_numpy(float)
        a, b = v / 2, np.full_like(v, 0.5)
        x = v / (v + t * t)
        flip = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
        lg = np.vectorize(lgamma, otypes=[float])
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 300):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
        beta = np.where(z <= 0, 0.0, front * f)
        yield pd.Series(np.where(np.isnan(t), np.nan, np.where(flip, 1 - beta, beta)))


def softmax_draws(df: DataFrame, keys: Sequence[str], point: str, score: str, top: float, draws: int, seed: int, slots: int = 4096) -> DataFrame:
    """Weighted draws with replacement among the top share of points by score: (keys, draw, point).

    Points at or above the (1 - top) quantile get weight exp(score).  A draw is
    a hashed uniform number looked up on the running sum of the weights.
    """
    keys = list(keys)
    q = exact_quantiles(df, keys, score, [1 - top]).select(*keys, F.col("q").alias("_cut"))
    kept = stage(df.join(q, keys).filter(F.col(score) >= F.col("_cut")).select(*keys, point, F.exp(score).alias("w")))
    cum = stage(running(kept, Track(tuple(keys), point, max(slots, 1)), {"hi": ("sum", F.col("w"))}))
    whole = cum.groupBy(*keys).agg(F.max("hi").alias("tot"))
    unit = 1 << 40  # positions of the lookup axis, as whole numbers
    asks = whole.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("seed", F.lit(seed))
    asks = asks.withColumn("at", (rank_hash(*keys, "seed", "draw") * F.lit(unit // (1 << 32))).cast("bigint"))
    marks = cum.join(whole, keys).select(
        *keys, F.floor((F.col("hi") - F.col("w")) / F.col("tot") * unit).alias("at"), F.struct("hi", point).alias("_p"), F.lit(0).alias("_tie")
    )
    axis = asks.select(*keys, "at", "draw", F.lit(1).alias("_tie")).unionByName(marks, allowMissingColumns=True)
    hit = running(axis, Track(tuple(keys), "at", unit // slots, tie=("_tie",)), {"_hit": ("max", F.col("_p"))})
    return hit.filter("_tie = 1").select(*keys, "draw", F.col(f"_hit.{point}").alias(point))

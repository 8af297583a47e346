"""Lagged joint tables, correlations and information measures of ordered signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.operators.ordered import Track, halo


def lagged_joint(df: DataFrame, track: Track, x: str, y: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (target now, target then, source then) per lag and direction.

    Direction 0: y is the target and x the source; direction 1 the reverse.
    Pairs never leave the key, since a lead beyond the last sample is NULL.
    """
    wide, w = halo(df.select(*dict.fromkeys((*track.keys, track.pos, x, y, *by))), track, ahead=lags)
    rows = []
    for lag in range(1, lags + 1):
        for d, (target, source) in enumerate(((y, x), (x, y))):
            rows.append(
                F.struct(
                    F.lit(lag).cast("bigint").alias("lag"),
                    F.lit(d).cast("bigint").alias("dir"),
                    F.lead(target, lag).over(w).alias("now"),
                    F.col(target).alias("then"),
                    F.col(source).alias("src"),
                )
            )
    flat = wide.select("_own", *by, F.array(*rows).alias("r")).filter("_own").select(*by, F.inline("r"))
    return flat.filter("now IS NOT NULL").groupBy(*by, "lag", "dir", "now", "then", "src").agg(F.count("*").alias("n"))


def lagged_joint_2d(df: DataFrame, track: Track, x: str, y: str, lags: int) -> DataFrame:
    """Counts of (target at lag1, source at lag2, target now) for every pair of lags and both directions."""
    wide, w = halo(df.select(*track.keys, track.pos, x, y), track, ahead=lags)
    lead = {(c, k): F.lead(c, k).over(w) for c in (x, y) for k in range(1, lags + 1)}
    wide = wide.select("*", *[e.alias(f"_{c}{k}") for (c, k), e in lead.items()]).filter("_own")
    rows = []
    for d, (target, source) in enumerate(((y, x), (x, y))):
        for l1 in range(1, lags + 1):
            for l2 in range(1, lags + 1):
                rows.append(
                    F.struct(
                        F.lit(l1).cast("bigint").alias("lag1"),
                        F.lit(l2).cast("bigint").alias("lag2"),
                        F.lit(d).cast("bigint").alias("dir"),
                        F.col(f"_{target}{l1}").alias("a"),
                        F.col(f"_{source}{l2}").alias("b"),
                        F.col(target).alias("c"),
                    )
                )
    flat = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return (
        flat.filter("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("lag1", "lag2", "dir", "a", "b", "c")
        .agg(F.count("*").alias("n"))
    )


def lagged_contrast_2d(df: DataFrame, track: Track, x: str, y: str, lags: int) -> DataFrame:
    """Counts of (target now, source ``lag1`` before, target ``lag2`` before) for every pair of lags and both directions.

    Direction 0: y is the target and x the source; direction 1 the reverse.
    """
    wide, w = halo(df.select(*track.keys, track.pos, x, y), track, ahead=lags)
    at = {(c, k): (F.lead(c, k).over(w) if k else F.col(c)) for c in (x, y) for k in range(lags + 1)}
    wide = wide.select("*", *[e.alias(f"_{c}{k}") for (c, k), e in at.items()]).filter("_own")
    rows = []
    for d, (target, source) in enumerate(((y, x), (x, y))):
        for l1 in range(1, lags + 1):
            for l2 in range(1, lags + 1):
                m = max(l1, l2)  # a row stands for the earliest of the three samples
                rows.append(
                    F.struct(
                        F.lit(l1).cast("bigint").alias("lag1"),
                        F.lit(l2).cast("bigint").alias("lag2"),
                        F.lit(d).cast("bigint").alias("dir"),
                        F.col(f"_{target}{m}").alias("now"),
                        F.col(f"_{source}{m - l1}").alias("src"),
                        F.col(f"_{target}{m - l2}").alias("then"),
                    )
                )
    flat = wide.select(F.inline(F.array(*rows))).filter("now IS NOT NULL")
    return flat.groupBy("lag1", "lag2", "dir", "now", "src", "then").agg(F.count("*").alias("n"))


def transfer_entropy(joint: DataFrame, by: Sequence[str] = ("lag", "dir")) -> DataFrame:
    """Sum of p log2(p(now, then, src) p(then) / (p(then, src) p(now, then))) from counts.

    The table holds at most bins^3 rows per group, so these windows are small.
    """
    by = list(by)

    def margin(*cols: str):
        return F.sum("n").over(W.partitionBy(*by, *cols)).cast("double")

    t = joint.select(
        *by,
        F.col("n").cast("double").alias("n"),
        margin().alias("all"),
        margin("then").alias("c"),
        margin("then", "src").alias("cs"),
        margin("now", "then").alias("nc"),
    )
    term = F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("c") / (F.col("cs") * F.col("nc")))
    return t.groupBy(*by).agg(F.sum(term).alias("te"))


def lagged_pairs(df: DataFrame, track: Track, x: str, y: str, lags: range, by: Sequence[str] = ()) -> DataFrame:
    """Moments of (x_n, y_{n+lag}) per key and lag, of either sign: n, sums and sum of products."""
    wide, w = halo(df.select(*track.keys, track.pos, *dict.fromkeys((x, y)), *by), track, ahead=max(map(abs, lags)))

    def ahead(c: str, k: int):
        return F.lead(c, k).over(w) if k > 0 else F.col(c)

    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), ahead(x, -k).alias("a"), ahead(y, k).alias("b")) for k in lags])
    flat = wide.select("_own", *track.keys, *by, rows.alias("r")).filter("_own").select(*track.keys, *by, F.inline("r"))
    return flat.filter("a IS NOT NULL AND b IS NOT NULL").groupBy(*track.keys, *by, "lag").agg(
        F.count("*").alias("n"),
        F.sum("a").alias("sa"),
        F.sum("b").alias("sb"),
        F.sum(F.col("a") * F.col("b")).alias("sab"),
        F.corr("a", "b").alias("r"),
    )


def correlation(df: DataFrame, track: Track, x: str, y: str, lags: range, scale: bool) -> DataFrame:
    """Demeaned lagged products over the number of overlaps; ``scale`` divides by both deviations.

    Means are those of the whole series, entered through the sums of the lagged pairs.
    """
    keys = list(track.keys)
    stat = df.groupBy(*keys).agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("ss")
    )
    mx, my = F.col("mx"), F.col("my")
    c = (F.col("sab") - mx * F.col("sb") - my * F.col("sa") + F.col("n") * mx * my) / F.col("n")
    pairs = lagged_pairs(df, track, x, y, lags)
    return pairs.join(stat, keys).select(*keys, "lag", (F.try_divide(c, F.col("ss")) if scale else c).alias("c"))


def gaussian_storage(df: DataFrame, track: Track, x: str, lags: range, pop: str) -> DataFrame:
    """-1/2 log2(1 - r^2) between a signal and its own past, per population and lag."""
    pairs = halo(df.select(*track.keys, track.pos, x, pop), track, ahead=max(lags))
    wide, w = pairs
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(x).alias("a"), F.lead(x, k).over(w).alias("b")) for k in lags])
    flat = wide.select("_own", pop, rows.alias("r")).filter("_own").select(pop, F.inline("r")).filter("b IS NOT NULL")
    r = F.col("r")
    return (
        flat.groupBy(pop, "lag")
        .agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
        .filter("n > 1")
        .select(pop, "lag", "n", (F.lit(-0.5) * F.log2(F.lit(1.0) - r * r)).alias("ais"))
    )

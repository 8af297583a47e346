"""Spectra, phases and interpolation as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions import spectral
from spiketide.functions.columns import as_col
from spiketide.session import stage


def spectrum(df: DataFrame, keys: Sequence[str], signal: str) -> DataFrame:
    """One row per (keys, k): amplitude of frequency index k.  No shuffle."""
    arr = df.select(*keys, spectral.amplitude(signal).alias("_a"))
    return arr.select(*keys, F.posexplode("_a").alias("k", "amp")).withColumn("k", F.col("k").cast("bigint"))


def frequency(k: Column | str, n: int, fs: float, compat: bool = False) -> Column:
    """Frequency of index k; ``compat`` stretches the axis so that the last bin sits at fs/2."""
    k = as_col(k).cast("double")
    return k * F.lit(fs / 2 / (n // 2 - 1)) if compat else k * F.lit(fs / n)


def dominant(spec: Column, k0: int, k1: int) -> Column:
    """Index and height of the largest local maximum of an amplitude array within [k0, k1)."""
    at = F.sequence(F.lit(k0 + 1), F.lit(k1 - 2))
    peaks = F.filter(
        F.transform(at, lambda k: F.struct(F.get(spec, k).alias("amp"), (-k).alias("k"), F.greatest(F.get(spec, k - 1), F.get(spec, k + 1)).alias("side"))),
        lambda p: p["amp"] > p["side"],
    )
    return F.array_max(peaks)


def stft(df: DataFrame, keys: Sequence[str], signal: str, width: int, hop: int) -> DataFrame:
    """(keys, frame, k, amp) of Hann-weighted frames; the frame is centred at width/2 + frame * hop."""
    arr = df.select(*keys, spectral.frame_amplitude(signal, width, hop).alias("_f"))
    frames = arr.select(*keys, F.posexplode("_f").alias("frame", "_a"))
    return frames.select(*keys, F.col("frame").cast("bigint").alias("frame"), F.posexplode("_a").alias("k", "amp")).withColumn(
        "k", F.col("k").cast("bigint")
    )


def band_phase(df: DataFrame, keys: Sequence[str], signal: str, k0: int, k1: int) -> DataFrame:
    """(keys, n, amp, phase) of the analytic signal of a frequency band."""
    z = df.select(*keys, spectral.band_signal(signal, k0, k1).alias("_z"))
    both = z.select(*keys, F.arrays_zip(F.col("_z.amp").alias("amp"), F.col("_z.phase").alias("phase")).alias("_r"))
    rows = both.select(*keys, F.posexplode("_r").alias("n", "r"))
    return rows.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("r")["amp"].alias("amp"), F.col("r")["phase"].alias("phase"))


def phase_at_peaks(df: DataFrame, keys: Sequence[str], signal: str, slow: tuple[int, int], fast: tuple[int, int]) -> DataFrame:
    """Phase of the slow band at the local maxima of the fast band's amplitude; one row per maximum."""
    z = df.select(*keys, spectral.band_signal(signal, *slow).alias("s"), spectral.band_signal(signal, *fast).alias("f"))
    at = F.sequence(F.lit(1), F.size("f.amp") - 2)
    a = F.col("f.amp")
    hits = F.filter(at, lambda i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1)))
    return z.select(*keys, F.explode(F.transform(hits, lambda i: F.get("s.phase", i))).alias("phase"))


def weighted_lookup(points: DataFrame, grid: DataFrame, axes: Sequence[str], value: str, keys: Sequence[str]) -> DataFrame:
    """Multilinear interpolation on a unit grid; points need columns named like the axes.

    Each point asks for the 2^d corners around it and the answers are summed,
    so the grid is joined by equality.  A point with a missing corner that has weight is NULL.
    """
    def split(a: str):
        frac = F.col(a) - F.floor(a)

        def both(c: Column) -> Column:
            here = [c[b].alias(b) for b in axes]
            there = [(c[b] + 1 if b == a else c[b]).alias(b) for b in axes]
            return F.array(
                F.struct(*here, (c["w"] * (1 - frac)).alias("w")), F.struct(*there, (c["w"] * frac).alias("w"))
            )

        return both

    corners = F.array(F.struct(*[F.floor(a).alias(a) for a in axes], F.lit(1.0).alias("w")))
    for a in axes:
        corners = F.flatten(F.transform(corners, split(a)))
    asks = points.select(*keys, F.inline(F.filter(corners, lambda c: c["w"] > 0)))
    got = asks.join(grid.select(*axes, F.col(value).alias("_v")), list(axes), "left")
    whole = F.count("*") == F.count("_v")
    return got.groupBy(*keys).agg(F.when(whole, F.sum(F.col("w") * F.col("_v"))).alias(value))


def z_levels(df: DataFrame, by: Sequence[str], value: str, lo: int, hi: int) -> DataFrame:
    """Whole-number level of the standardised value, clipped to [lo, hi]."""
    s = stage(df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")))
    z = F.floor(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return df.join(s, list(by)).withColumn("level", F.least(F.greatest(z, F.lit(lo)), F.lit(hi)).cast("bigint")).drop("_m", "_s")


def rest_threshold(avg: DataFrame, by: Sequence[str], k: str, value: str, bands: Sequence[tuple[int, int]], factor: float = 1.2) -> DataFrame:
    """Detection threshold from a mean spectrum.

    Inside a band the mean itself is the threshold.  Left of the first and right
    of the last band it is ``factor`` times the mean at the band's border;
    between two bands a straight line between the borders, times ``factor``.
    """
    w = W.partitionBy(*by)  # one row per frequency index
    first, last = bands[0][0], bands[-1][1]

    def border(at: int) -> Column:
        return F.max(F.when(F.col(k) == at, F.col(value))).over(w)

    th = F.when(F.col(k) < first, border(first) * factor).when(F.col(k) > last, border(last) * factor)
    for (_, a), (b, _) in zip(bands[:-1], bands[1:]):
        line = border(a) + (border(b) - border(a)) * (F.col(k) - a) / (b - a)
        th = th.when((F.col(k) > a) & (F.col(k) < b), line * factor)
    return avg.withColumn("th", th.otherwise(F.col(value)))

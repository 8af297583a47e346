"""Small column expressions shared by the operators."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def floor_div(c: Column | str, width: int) -> Column:
    """Whole-number floor division, exact for every bigint."""
    c = as_col(c).cast("bigint")
    w = F.lit(width).cast("bigint")
    return F.call_function("div", c - F.pmod(c, w), w)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (session zone UTC)."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def total(cols: Sequence[Column]) -> Column:
    return functools.reduce(operator.add, cols)


def bin_of(c: Column | str, start: float, width: float, bins: int) -> Column:
    """Half-open bin index; NULL outside, so the right edge is dropped."""
    b = F.floor((as_col(c) - F.lit(start)) / F.lit(width)).cast("bigint")
    return F.when((b >= 0) & (b < bins), b)


def zero_filled_moments(k: Column, mean: Column, var: Column, n: Column) -> tuple[Column, Column]:
    """Mean and population variance of n values of which only k are stored.

    The n - k missing values are zeros; merging the two groups by their
    moments avoids building the missing rows.
    """
    avg = k * mean / n
    return avg, (k * var + mean * mean * k * (n - k) / n) / n


def encode_index(indices: Sequence[Column | str], sizes: Sequence[int | Column]) -> Column:
    """Row-major flat id; NULL as soon as one index leaves its axis."""
    cols = [as_col(i).cast("bigint") for i in indices]
    flat = functools.reduce(lambda acc, cs: acc * cs[1] + cs[0], zip(cols, sizes), F.lit(0).cast("bigint"))
    inside = functools.reduce(operator.and_, [(c >= 0) & (c < s) for c, s in zip(cols, sizes)])
    return F.when(inside, flat)


def decode_index(flat: Column | str, sizes: Sequence[int]) -> list[Column]:
    flat = as_col(flat)
    out = []
    for i, size in enumerate(sizes):
        below = math.prod(sizes[i + 1 :])
        out.append(F.pmod(floor_div(flat, below), F.lit(size).cast("bigint")))
    return out


def linspace(x0: float, x1: float, n: int) -> Column:
    """Array of n evenly spaced values; one value means the start."""
    if n == 1:
        return F.array(F.lit(float(x0)))
    step = (x1 - x0) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(x0)) + i * F.lit(step))


def circular_mean(phase: Column) -> Column:
    return F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase)))


def circular_dispersion(phase: Column) -> Column:
    """1 - R^2 of the mean unit vector."""
    return F.lit(1.0) - (F.pow(F.avg(F.cos(phase)), 2) + F.pow(F.avg(F.sin(phase)), 2))


def angle_spread_compat(phase: Column) -> Column:
    """Mean angle of the squared values less the square of the mean angle: an older measure, no circular deviation."""
    return circular_mean(phase * phase) - F.pow(circular_mean(phase), 2)


def period_ms(frequency: Column | str, fallback: float = 30.0) -> Column:
    """Length of a cycle in milliseconds; without a positive frequency the fallback."""
    f = as_col(frequency)
    return F.when(f > 0, F.lit(1000.0) / f).otherwise(F.lit(fallback))


def in_band(frequency: Column | str, pop: Column | str, bands: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Whether a frequency lies strictly inside the (low, high) of its own population; an open end is None."""
    f, out = as_col(frequency), F.lit(None).cast("boolean")
    for name, (low, high) in bands.items():
        above = F.lit(True) if low is None else f > low
        below = F.lit(True) if high is None else f < high
        out = F.when(as_col(pop) == name, above & below).otherwise(out)
    return out


def motif_flags(label: Column | str) -> Column:
    """Four 0/1 flags of a label such as ``F(fs)S(-s)``: fast and slow of either population."""
    c = as_col(label)
    marks = ((3, "f"), (4, "s"), (8, "f"), (9, "s"))  # fixed values: places counted from one
    flags = F.array(*[(F.substring(c, at, 1) == mark).cast("int") for at, mark in marks])
    return F.when(c.startswith("F"), flags)


def logistic(x: Column | str, gain: float = 1.0, mid: float = 0.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-gain) * (as_col(x) - F.lit(mid))))


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def ln_factorial(n: Column | str) -> Column:
    """ln(n!) by a product for small n and the Stirling series above."""
    n = as_col(n).cast("double")
    small = F.ln(F.factorial(F.least(n, F.lit(20.0)).cast("int")).cast("double"))
    x = n + F.lit(1.0)
    big = (
        (x - 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi))
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    )
    return F.when(n <= 20, small).otherwise(big)


def rank_hash(*parts: str) -> Column:
    """32-bit pseudo-random rank from key columns, the same on every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")

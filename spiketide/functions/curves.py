"""Curve fits of bounded arrays, all curves of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("a0", "f0", "g0", "a1", "f1", "g1", "base")
FIELDS = ", ".join(f"{n}: double" for n in NAMES)
ROUNDS = 5_000  # at most; curves are done when nothing pulls
CALM = 1e-9


def two_lines(f: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model and its derivatives for curves p (n x 7): two Lorentz lines a / pi * g / ((f - f0)^2 + g^2) over one baseline."""
    y, d = np.repeat(p[:, 6:7], len(f), axis=1), np.ones((len(p), len(f), 7))
    for k in (0, 3):
        a, x0, g = (p[:, k + i : k + i + 1] for i in range(3))
        gap = f - x0
        low = gap * gap + g * g
        line = g / low / np.pi
        y += a * line
        d[:, :, k] = line
        d[:, :, k + 1] = a * line * 2 * gap / low
        d[:, :, k + 2] = a / np.pi * (gap * gap - g * g) / (low * low)
    return y, d


def fit_two(f: np.ndarray, y: np.ndarray, split: float) -> np.ndarray:
    """Damped least squares for all rows of ``y``: a line below ``split`` and one above it, inside bounds.

    A step that makes a curve worse is not taken and raises that curve's
    damping; each curve goes its own way.  Parameters on a bound whose step
    points outwards are held there.
    """
    n, span = len(y), f[-1] - f[0]
    low_side = f < split
    base = y.min(axis=1)
    p = np.zeros((n, 7))
    for k, side in ((0, low_side), (3, ~low_side)):
        at = f[side][y[:, side].argmax(axis=1)]
        height = y[:, side].max(axis=1) - base
        p[:, k + 1], p[:, k + 2] = at, span / 16
        p[:, k] = height * np.pi * span / 16
    p[:, 6] = base
    most = np.maximum(y.max(axis=1), 1e-12)
    lower = np.tile([0, f[0], span / 1000, 0, split, span / 1000, 0.0], (n, 1))
    upper = np.stack([10 * np.pi * span * most, np.full(n, split), np.full(n, span), 10 * np.pi * span * most, np.full(n, f[-1]), np.full(n, span), most], axis=1)
    p = np.clip(p, lower, upper)
    damp, power = np.full(n, 1e-2), (y * y).sum(axis=1)
    model, jac = two_lines(f, p)
    cost = ((y - model) ** 2).sum(axis=1)
    for _ in range(ROUNDS):
        pull = np.einsum("nfk,nf->nk", jac, y - model)
        held = ((p <= lower) & (pull < 0)) | ((p >= upper) & (pull > 0))
        free = ~held
        if (np.abs(pull * free) * np.maximum(np.abs(p), 1e-3) <= CALM * power[:, None]).all():
            break
        normal = np.einsum("nfk,nfm->nkm", jac, jac) * free[:, :, None] * free[:, None, :]
        size = np.einsum("nkk->nk", normal)
        normal[:, np.arange(7), np.arange(7)] += damp[:, None] * size + held + 1e-300
        step = np.linalg.solve(normal + 1e-14 * size.max(axis=1)[:, None, None] * np.eye(7), (pull * free)[:, :, None])[:, :, 0]
        trial = np.clip(p + step, lower, upper)
        seen, slope = two_lines(f, trial)
        now = ((y - seen) ** 2).sum(axis=1)
        better = now < cost
        p[better], model[better], jac[better], cost[better] = trial[better], seen[better], slope[better], now[better]
        damp = np.clip(np.where(better, damp / 3, damp * 4), 1e-12, 1e12)
        if (damp >= 1e12).all():
            break
    return p


def lorentz_pair(freq: Column | str, power: Column | str, split: float) -> Column:
    """Struct of the seven parameters (NAMES) of the best two lines over a baseline; null for fewer than 8 samples, null or NaN ones.

    Curves on the same frequencies are fitted together.
    """

    @F.pandas_udf(f"struct<{FIELDS}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for fs, ys in batches:
            out = np.full((len(fs), 7), np.nan)
            groups: dict[bytes, list[int]] = {}
            curves: list[np.ndarray | None] = []
            for i, (f, y) in enumerate(zip(fs, ys)):
                f, y = (np.asarray(x if x is not None else [], float) for x in (f, y))
                whole = len(f) == len(y) >= 8 and not np.isnan(f).any() and not np.isnan(y).any() and (f < split).any() and (f >= split).any()
                curves.append(y if whole else None)
                if whole:
                    groups.setdefault(f.tobytes(), []).append(i)
            for f, at in groups.items():
                out[at] = fit_two(np.frombuffer(f), np.stack([curves[i] for i in at]), split)
            rows = pd.DataFrame(out, columns=list(NAMES)).astype(object)
            yield rows.where(rows.notna(), None)

    return run(freq, power)


def pull(fit: str, freq: str, power: str) -> dict[str, Column]:
    """Column expressions of the normal equations at a fitted point: sum of residual x derivative for each parameter.

    They are 0 where a parameter is free, and point outwards where it is on a bound.
    """
    p = {n: F.col(f"{fit}.{n}") for n in NAMES}

    def line(x: Column, k: str) -> tuple[Column, Column, Column]:
        gap = x - p[f"f{k}"]
        low = gap * gap + p[f"g{k}"] * p[f"g{k}"]
        return p[f"g{k}"] / low / F.pi(), gap, low

    def slope(name: str, x: Column) -> Column:
        if name == "base":
            return F.lit(1.0)
        shape, gap, low = line(x, name[1])
        a, g = p[f"a{name[1]}"], p[f"g{name[1]}"]
        return {"a": shape, "f": a * shape * 2 * gap / low, "g": a / F.pi() * (gap * gap - g * g) / (low * low)}[name[0]]

    def left(x: Column, y: Column) -> Column:
        return y - p["a0"] * line(x, "0")[0] - p["a1"] * line(x, "1")[0] - p["base"]

    def total(name: str) -> Column:
        each = F.zip_with(freq, power, lambda x, y: left(x, y) * slope(name, x))
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)

    return {n: total(n) for n in NAMES}

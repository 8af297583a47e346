"""Arrow helpers for one short array per row (a chunk of signal of bounded length)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _by_length(batch: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """Apply a matrix function to the rows of equal length together."""
    out = [None] * len(batch)
    sizes = batch.map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        res = fn(np.stack([np.asarray(batch.iloc[i], dtype=float) for i in at]))
        for i, row in zip(at, res):
            out[i] = row.tolist()
    return pd.Series(out)


def amplitude(signal: Column | str) -> Column:
    """2/N |DFT| for the first N/2 frequencies."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield _by_length(b, lambda x: 2 / x.shape[1] * np.abs(np.fft.rfft(x, axis=1)[:, : x.shape[1] // 2]))

    return run(signal)


def frame_amplitude(signal: Column | str, width: int, hop: int) -> Column:
    """Amplitudes of Hann-weighted frames centred at width/2, width/2 + hop, ...; no gain correction."""

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        win = np.hanning(width)

        def frames(x: np.ndarray) -> np.ndarray:
            if x.shape[1] <= width:
                return np.empty((len(x), 0, width // 2))
            cut = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, : x.shape[1] - width : hop]
            return 2 / width * np.abs(np.fft.rfft(cut * win, axis=2)[:, :, : width // 2])

        for b in batches:
            yield _by_length(b, frames)

    return run(signal)


def band_signal(signal: Column | str, k0: int, k1: int) -> Column:
    """Analytic signal of the DFT band k0..k1: struct(amp, phase) of arrays."""

    @F.pandas_udf("struct<amp: array<double>, phase: array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def analytic(x: np.ndarray) -> np.ndarray:
            y = np.fft.fft(x, axis=1)
            keep = np.zeros(x.shape[1])
            keep[k0 : k1 + 1] = 2.0
            z = np.fft.ifft(y * keep, axis=1)
            return np.stack([np.abs(z), np.angle(z)], axis=1)

        for b in batches:
            both = _by_length(b, analytic)
            yield pd.DataFrame({"amp": both.map(lambda r: r[0]), "phase": both.map(lambda r: r[1])})

    return run(signal)


def lorentz_fit(freq: Column | str, power: Column | str, rounds: int = 200) -> Column:
    """Fit height / (1 + ((f - centre) / width)^2) by damped Gauss-Newton steps.

    Returns struct(centre, width, height, lo, hi) with the range centre +- half
    of the width, rounded to two places.
    """

    @F.pandas_udf("struct<centre: double, width: double, height: double, lo: double, hi: double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def fit(f: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
            span = f[-1] - f[0]
            top = int(np.argmax(y))
            p = np.array([f[top], span / 8, y[top]])
            lower, upper = np.array([f[0], span * 1e-3, 0.0]), np.array([f[-1], span, 10 * y[top] + 1e-12])

            def model(q):
                return q[2] / (1 + ((f - q[0]) / q[1]) ** 2)

            damp, cost = 1e-2, np.sum((y - model(p)) ** 2)
            for _ in range(rounds):
                u = (f - p[0]) / p[1]
                base = 1 / (1 + u * u)
                jac = np.stack([p[2] * base**2 * 2 * u / p[1], p[2] * base**2 * 2 * u * u / p[1], base], axis=1)
                hess = jac.T @ jac
                step = np.linalg.lstsq(hess + damp * np.diag(np.diag(hess) + 1e-12), jac.T @ (y - model(p)), rcond=None)[0]
                trial = np.clip(p + step, lower, upper)
                c = np.sum((y - model(trial)) ** 2)
                if c < cost:
                    if cost - c < 1e-14 * max(cost, 1e-300):
                        p = trial
                        break
                    p, cost, damp = trial, c, damp / 3
                else:
                    damp *= 4
                    if damp > 1e12:
                        break
            return float(p[0]), float(p[1]), float(p[2]), round(p[0] - p[1] / 2, 2), round(p[0] + p[1] / 2, 2)

        for fs, ys in batches:
            rows = [fit(np.asarray(f, float), np.asarray(y, float)) for f, y in zip(fs, ys)]
            yield pd.DataFrame(rows, columns=["centre", "width", "height", "lo", "hi"])

    return run(freq, power)

"""Spectra of signals stored as rows against a transform of the whole array."""

from __future__ import annotations

import numpy as np
import pytest

from spiketide.operators import spectra
from spiketide.operators.ordered import Track, find_hot

DRAW = np.random.default_rng(3)
SIGNALS = {1: DRAW.normal(size=300), 2: DRAW.normal(size=21), 3: DRAW.normal(size=20), 4: DRAW.normal(size=3), 5: np.cos(2 * np.pi * 2 * np.arange(64) / 8)}


def frame(spark, width: int, signals=SIGNALS):
    rows = [(u, n, float(v)) for u, x in signals.items() for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "u long, n long, x double")
    hot, flat = find_hot(df, ["u"], width)
    return df, Track(("u",), "n", width, hot=hot, flat=flat)


@pytest.mark.parametrize("width", [20, 33, 1000])
@pytest.mark.parametrize("nbin, hann", [(None, True), (32, False)])
def test_frames_of_any_length_of_signal(spark, width, nbin, hann):
    got = {(r.u, r.frame): r.amps for r in spectra.frame_spectrum(*frame(spark, width), "x", 20, 7, nbin, hann).collect()}
    want = {}
    for u, x in SIGNALS.items():
        for f in range(0, 1 + max(0, len(x)) // 7):
            if f * 7 + 20 < len(x):
                cut = x[f * 7 : f * 7 + 20] * (np.hanning(20) if hann else 1)
                size = nbin or 20
                want[u, f] = 2 / size * np.abs(np.fft.fft(cut, size))[: size // 2]
    assert got.keys() == want.keys() and {u for u, _ in want} == {1, 2, 5}
    assert all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("nbin", [None, 50])
def test_whole_signals(spark, nbin):
    got = {(r.u, r.k): (r["size"], r.amp) for r in spectra.row_spectrum(*frame(spark, 33), "x", 0, 9, nbin).collect()}
    for u, x in SIGNALS.items():
        size = nbin or len(x)
        want = 2 / size * np.abs(np.fft.fft(x, size))[: size // 2][:9]
        assert np.allclose([got[u, k][1] for k in range(len(want))], want)
        assert all(s == size for (v, _), (s, _) in got.items() if v == u)


def test_a_cosine_has_one_line(spark):
    rows = spectra.row_spectrum(*frame(spark, 1000, {5: SIGNALS[5][:8]}), "x", 0, 4).orderBy("k").collect()
    assert np.allclose([r.amp for r in rows], [0, 0, 1, 0])


def test_missing_samples_and_empty_table(spark):
    df = spark.createDataFrame([(1, n, None if n == 9 else float("nan") if n == 20 else 1.0) for n in range(40)], "u long, n long, x double")
    track = Track(("u",), "n", 64, flat=True)
    frames = [r.frame for r in spectra.frame_spectrum(df, track, "x", 4, 1).collect()]
    assert sorted(frames) == [f for f in range(36) if not set(range(f, f + 4)) & {9, 20}]
    assert [r.amp for r in spectra.row_spectrum(df, track, "x", 0, 1).collect()] == [pytest.approx(2 * 38 / 40)]
    assert spectra.frame_spectrum(df.limit(0), track, "x", 4, 1).collect() == []
    with pytest.raises(ValueError):
        spectra.frame_spectrum(df, track, "x", 8, 1, nbin=4)


def test_windows_and_the_peak_of_their_mean(spark):
    df, track = frame(spark, 33)
    asks = [(1, 0, 5), (1, 1, 100), (1, 2, 295), (2, 0, 0), (4, 0, 0)]  # the third and the last are not complete
    starts = spark.createDataFrame(asks, "u long, window long, start long")
    rows = {(r.u, r.window): r.amps for r in spectra.window_spectrum(df, track, "x", starts, 16).collect()}
    want = {(u, w): 2 / 16 * np.abs(np.fft.fft(SIGNALS[u][s : s + 16]))[:8] for u, w, s in asks if s + 16 <= len(SIGNALS[u])}
    assert rows.keys() == want.keys() and all(np.allclose(rows[k], want[k]) for k in want)
    mean = spectra.mean_spectrum(spectra.window_spectrum(df, track, "x", starts, 16), ["u"])
    top = {r.u: (r.k, r.amp) for r in spectra.peak_frequency(mean, ["u"], 1, 7).collect()}
    average = (want[1, 0] + want[1, 1]) / 2
    assert top[1] == (1 + int(np.argmax(average[1:])), pytest.approx(average[1:].max()))

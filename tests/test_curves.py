"""Two Lorentz lines over a baseline: known curves come back, noisy ones end where nothing pulls."""

from __future__ import annotations

import numpy as np

from spiketide.functions import curves

F_AXIS = np.arange(0.0, 64.0)
TRUE = np.array([[5, 12, 2, 8, 40, 4, 0.1], [3, 20, 1.5, 3, 35, 6, 0.3], [2, 5, 3, 9, 50, 2, 0]])


def test_known_curves_come_back():
    found = curves.fit_two(F_AXIS, curves.two_lines(F_AXIS, TRUE)[0], 30.0)
    assert np.allclose(found, TRUE, atol=1e-4)


def test_derivatives_are_those_of_the_model():
    _, slope = curves.two_lines(F_AXIS, TRUE)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        numeric = (curves.two_lines(F_AXIS, TRUE + step)[0] - curves.two_lines(F_AXIS, TRUE - step)[0]) / 2e-6
        assert np.allclose(slope[:, :, k], numeric, atol=1e-6)


def test_in_spark_with_odd_rows_and_whatever_the_batch(spark):
    draw = np.random.default_rng(6)
    noisy = curves.two_lines(F_AXIS, TRUE)[0] + draw.normal(size=(3, 64)) * 0.01
    axis = F_AXIS.tolist()
    rows = [(k, axis, y.tolist()) for k, y in enumerate(noisy)]
    rows += [(7, None, None), (8, axis[:5], axis[:5]), (9, axis, [None] * 64), (10, axis, axis[:9]), (11, axis[:20], axis[:20])]
    df = spark.createDataFrame(rows, "id long, f array<double>, y array<double>").repartition(3)
    fit = df.withColumn("fit", curves.lorentz_pair("f", "y", 30.0))
    got = {r.id: r for r in fit.select("id", "fit", *[c.alias(f"pull_{n}") for n, c in curves.pull("fit", "f", "y").items()]).collect()}
    want = curves.fit_two(F_AXIS, noisy, 30.0)
    for k in range(3):
        assert np.allclose(list(got[k].fit), want[k], rtol=1e-6, atol=1e-8)
        free = [n for n in curves.NAMES if not (n == "base" and got[k].fit.base == 0)]
        assert all(abs(got[k][f"pull_{n}"]) < 1e-6 for n in free)
    assert all(v is None for k in (7, 8, 9, 10, 11) for v in got[k].fit)

"""Two-axis smoothing against a mirrored convolution of the whole map."""

from __future__ import annotations

import numpy as np
import pytest

from spiketide.operators import maps

TAPS = [0.1, 0.2, 0.4, 0.2, 0.1]


def whole(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        padded = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(w * np.take(padded, range(k, k + x.shape[axis]), axis) for k, w in enumerate(TAPS))
    return x


@pytest.mark.parametrize("block", [2, 3, 5, 64])
def test_blocks_and_mirrored_borders(spark, block):
    draw = np.random.default_rng(2)
    shape = 11, 7
    full = {1: draw.integers(0, 9, shape).astype(float), 2: np.zeros(shape)}
    full[2][0, 0], full[2][10, 6] = 4, 1
    rows = [(k, r, c, float(x[r, c])) for k, x in full.items() for r in range(11) for c in range(7) if x[r, c]]
    rows += [(1, -1, 0, 9.0), (1, 0, 7, 9.0), (1, 3, 3, None), (1, 3, 4, float("nan")), (2, 5, 3, 1.0), (2, 5, 3, 2.0)]
    full[2][5, 3] = 3
    df = spark.createDataFrame(rows, "key long, a long, b long, v double")
    got = {k: np.zeros(shape) for k in full}
    for r in maps.smooth_map(df, ["key"], "a", "b", "v", shape, TAPS, block).collect():
        got[r.key][r.row, r.col] = r.smooth
    for k, x in full.items():
        assert np.allclose(got[k], whole(x))
    assert maps.smooth_map(df.limit(0), ["key"], "a", "b", "v", shape, TAPS, block).collect() == []


def test_taps_must_fit(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0)], "key long, a long, b long, v double")
    with pytest.raises(ValueError):
        maps.smooth_map(df, ["key"], "a", "b", "v", (1, 5), TAPS)

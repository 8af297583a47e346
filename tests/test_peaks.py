"""Peaks by prominence against a walk over all samples, with chunks so narrow that stacks cross many borders."""

from __future__ import annotations

import random

import pytest

from spiketide.operators import peaks
from spiketide.operators.ordered import Track, find_hot


def brute(u: int, x: list[float | None]) -> list[tuple]:
    out, n = [], len(x)
    for i in range(n):
        if x[i] is None or (i and x[i - 1] == x[i]):
            continue
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if i == 0 or j == n - 1 or x[i - 1] is None or x[j + 1] is None or x[i - 1] > x[i] or x[j + 1] > x[i]:
            continue
        lows = []
        for way in (range(i - 1, -1, -1), range(j + 1, n)):
            low, base = x[i], -1
            for k in way:
                if x[k] is None or x[k] > x[i]:
                    break
                if x[k] < low:
                    low, base = x[k], k
            lows.append((low, base))
        (a, left), (b, right) = lows
        out.append((u, (i + j) // 2, i, j, x[i], x[i] - max(a, b), left, right))
    return out


def walk(n: int, seed: int, step: int) -> list[float]:
    draw = random.Random(seed)
    x = [0.0]
    for _ in range(n - 1):
        x.append(x[-1] + draw.randint(-step, step))
    return x


UNITS = {
    0: walk(400, 1, 2),  # most of all rows, with many ties
    1: [float(k % 2 * (k + 1)) for k in range(90)],  # ever higher peaks: all ask to the left
    2: [float(k % 2 * (200 - k)) for k in range(91)],  # ever lower peaks
    3: [5.0, 1.0, 1.0, 3.0, 3.0, 1.0, 1.0, 4.0, 4.0, 4.0, 4.0, 2.0, 5.0],
    4: [1.0],
    5: [2.0] * 40,
    6: [0.0, *walk(60, 3, 4), None, *walk(50, 4, 4), None, None, 1.0, 2.0, 1.0],
    7: [9.0] + [float(k % 3) for k in range(70)] + [9.0],
}


@pytest.mark.parametrize("width", [8, 33, 1000])
def test_all_units(spark, width):
    rows = [(u, n, v) for u, x in UNITS.items() for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "u long, n long, x double")
    hot, flat = find_hot(df, ["u"], width)
    found = peaks.peaks(df, Track(("u",), "n", width, hot=hot, flat=flat), "x")
    want = sorted(r for u, x in UNITS.items() for r in brute(u, x))
    assert sorted(tuple(r) for r in found.collect()) == want


def test_nan_cuts_like_null_and_empty_table(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, float("nan"), 0.0, 2.0, 1.0, 3.0, 0.0])], "u long, n long, x double")
    track = Track(("u",), "n", 8, flat=True)
    assert [tuple(r)[1:] for r in peaks.peaks(df, track, "x").orderBy("n").collect()] == [(3, 3, 3, 2.0, 1.0, 2, 4), (5, 5, 5, 3.0, 3.0, 2, 6)]
    assert peaks.peaks(df.limit(0), track, "x").collect() == []

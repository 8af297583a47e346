"""Rotated counts against brute force, for units of one chunk and of many."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from spiketide.operators import rotations
from spiketide.operators.ordered import Track, find_hot

DRAW = random.Random(12)
UNITS = {1: 97, 2: 40, 3: 5, 4: 1, 5: 33}
ROWS = [(u, n, DRAW.randrange(3), DRAW.randrange(4)) for u, length in UNITS.items() for n in range(length)]


def brute(rounds: int, lags: int) -> dict:
    out: Counter = Counter()
    for u, length in UNITS.items():
        x = [r[2] for r in ROWS if r[0] == u]
        y = [r[3] for r in ROWS if r[0] == u]
        for r in range(rounds):
            o = int(hashlib.md5(f"{u}:{r}".encode()).hexdigest()[:8], 16) % length
            z = [x[(p + o) % length] for p in range(length)]
            if not lags:
                out.update((r, a, b) for a, b in zip(z, y))
            for lag in range(1, lags + 1):
                for p in range(length - lag):
                    out[r, lag, 0, y[p + lag], y[p], z[p]] += 1
                    out[r, lag, 1, z[p + lag], z[p], y[p]] += 1
    return out


@pytest.mark.parametrize("width", [8, 33, 1000])
@pytest.mark.parametrize("lags", [0, 3])
def test_all_rounds(spark, width, lags, monkeypatch):
    monkeypatch.setattr(rotations, "STEP", 5)
    df = spark.createDataFrame(ROWS, "u long, n long, x long, y long")
    hot, flat = find_hot(df, ["u"], width)
    found = rotations.rotated_counts(df, Track(("u",), "n", width, hot=hot, flat=flat), "x", "y", lags, 7).collect()
    assert {tuple(r)[:-1]: r.n for r in found} == brute(7, lags)


def test_states_must_be_few_whole_numbers(spark):
    track = Track(("u",), "n", 9, flat=True)
    for rows in ([(1, 0, -1, 0)], [(1, 0, 300, 0)], [(1, 0, None, 0)]):
        with pytest.raises(ValueError):
            rotations.rotated_counts(spark.createDataFrame(rows, "u long, n long, x long, y long"), track, "x", "y", 1, 2)
    with pytest.raises(ValueError):
        rotations.rotated_counts(spark.createDataFrame([(1, 0, 254, 0)], "u long, n long, x long, y long"), track, "x", "y", 3, 100)
    empty = spark.createDataFrame([], "u long, n long, x long, y long")
    assert rotations.rotated_counts(empty, track, "x", "y", 1, 2).collect() == []

"""Chunk bootstrap and active information storage against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from spiketide.operators import chunked
from spiketide.operators.ordered import Track, dense_rank_of_all

DRAW = random.Random(4)
UNITS = {1: 200, 2: 33, 3: 16, 4: 7}
ROWS = [(u, n, DRAW.randrange(3), DRAW.randrange(2)) for u, length in UNITS.items() for n in range(length)]


def frame(spark):
    return spark.createDataFrame(ROWS, "u long, n long, x long, y long"), Track(("u",), "n", 1000, flat=True)


def entropy_of(cells: Counter) -> float:
    """Sum of p log2(p(now, then, src) p(then) / (p(then, src) p(now, then))) by definition."""
    total = sum(cells.values())
    out = 0.0
    for (now, then, src), n in cells.items():
        c = sum(k for (_, t, _), k in cells.items() if t == then)
        cs = sum(k for (_, t, s), k in cells.items() if (t, s) == (then, src))
        nc = sum(k for (m, t, _), k in cells.items() if (m, t) == (now, then))
        out += n / total * math.log2(n * c / (cs * nc))
    return out


def test_bootstrap_rounds(spark):
    df, track = frame(spark)
    got = {(r.round, r.lag, r.dir): r.te for r in chunked.chunk_bootstrap(df, track, "x", "y", 8, 3, 5, 40, 23).collect()}
    chunks = [(u, c) for u, length in UNITS.items() for c in range(length // 8)]
    places = dense_rank_of_all(spark.createDataFrame(chunks, "u long, chunk long").repartition(5), ["u", "chunk"])
    assert sorted((r["rank"], r.u, r.chunk) for r in places.collect()) == [(k, *c) for k, c in enumerate(chunks)]
    drawn: dict = {}
    for r in chunked.drawn_chunks(places, 5, 40, 23).collect():
        drawn.setdefault(r["round"], {})[r["rank"]] = r.times
    assert [sum(drawn[r].values()) for r in range(5)] == [40] * 5 and drawn[0] != drawn[1]
    value = {(u, n): (x, y) for u, n, x, y in ROWS}
    for (r, lag, direction), te in got.items():
        cells: Counter = Counter()
        for rank, times in drawn[r].items():
            u, c = chunks[rank]
            for n in range(c * 8, c * 8 + 8 - lag):
                source, target = (0, 1) if direction == 0 else (1, 0)
                cells[value[u, n + lag][target], value[u, n][target], value[u, n][source]] += times
        assert te == pytest.approx(entropy_of(cells), abs=1e-12)
    assert len(got) == 5 * 3 * 2


def test_nothing_without_a_whole_chunk(spark):
    df, track = frame(spark)
    assert chunked.chunk_bootstrap(df.filter("u = 4"), track, "x", "y", 8, 3, 5, 40, 23).collect() == []
    assert chunked.active_information(df.limit(0), track, "x", 8, [1, 2]).collect() == []


def test_active_information_against_the_closed_form(spark):
    noise = np.random.default_rng(8).normal(size=127)
    x = np.convolve(noise, [1, 0.8, 0.5])[:127]
    rows = [(1, n, float(v)) for n, v in enumerate(x)] + [(2, n, 1.0) for n in range(40)]
    df = spark.createDataFrame(rows, "u long, n long, x double")
    got = {r.lag: (r.chunks, r.ais) for r in chunked.active_information(df, Track(("u",), "n", 1000, flat=True), "x", 20, [1, 2, 4]).collect()}

    def psi(v: float) -> float:  # whole and half arguments by their finite sums
        if v == int(v):
            return -0.5772156649015329 + sum(1 / k for k in range(1, int(v)))
        return -0.5772156649015329 - 2 * math.log(2) + sum(2 / (2 * k - 1) for k in range(1, int(v + 0.5)))

    for lag in (1, 2, 4):
        values = []
        for c in range(6):
            a, b = x[c * 20 : c * 20 + 16], x[c * 20 + lag : c * 20 + 16 + lag]
            r = np.corrcoef(a, b)[0, 1]
            values.append((-0.5 * math.log(1 - r * r) + (psi(16 / 2 - 1) - psi(16 / 2 - 0.5)) / 2) / math.log(2))
        assert got[lag] == (6, pytest.approx(np.mean(values), abs=1e-9))  # the constant unit has no estimate


def test_too_short_chunks_are_refused(spark):
    df, track = frame(spark)
    with pytest.raises(ValueError):
        chunked.active_information(df, track, "x", 6, [4])

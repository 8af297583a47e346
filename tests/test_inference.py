from __future__ import annotations

import hashlib

import numpy as np
import pytest

from spiketide.operators import inference

ROUNDS = 30


def plain(rows, first, rounds):
    """Differences of means of all rounds by sorting every round."""
    base = [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % inference.PRIME for i, _ in rows]
    out = []
    for r in range(rounds):
        order = sorted(range(len(rows)), key=lambda k: (base[k] * inference.split_factor(r) % inference.PRIME, rows[k][0]))
        x = np.array([rows[k][1] for k in order])
        out.append(x[:first].mean() - x[first:].mean())
    return out


@pytest.mark.parametrize("chunk, buckets, held", [(4_096, 1_024, 1 << 26), (7, 4, 0)])
def test_permutations_against_sorting_every_round(spark, monkeypatch, chunk, buckets, held):
    monkeypatch.setattr(inference, "CHUNK", chunk)
    monkeypatch.setattr(inference, "BUCKETS", buckets)
    monkeypatch.setattr(inference, "HELD_BYTES", held)
    draw = np.random.default_rng(4)
    groups = {"a": 3, "b": 60, "c": 400}
    rows = [(g, i, float(draw.normal()), i % 3 == 0) for g, n in groups.items() for i in range(n)]
    df = spark.createDataFrame(rows + [(None, 5, 1.0, True)], "g string, id long, x double, f boolean")
    got = {r.g: r for r in inference.permutation_test(df, ["g"], "id", "x", "f", ROUNDS).collect()}
    assert set(got) == set(groups)
    for g in groups:
        own = [(i, x) for k, i, x, _ in rows if k == g]
        first = sum(f for k, _, _, f in rows if k == g)
        assert np.allclose([got[g].lo, got[g].hi], np.quantile(plain(own, first, ROUNDS), [0.01, 0.99]))


def test_no_row_is_multiplied_by_the_rounds(spark):
    df = spark.range(200).selectExpr("'k' as g", "id", "cast(id % 7 as double) as x", "id % 2 = 0 as f")
    plan = inference.permutation_test(df, ["g"], "id", "x", "f", ROUNDS)
    chunks = inference._chunks(df, df.selectExpr("g", "200L as n", "100L as nx", "0L as _gid").distinct(), ["g"], "id", "x")
    assert chunks.count() == 1 and plan.count() == 1

"""Non-negative factors: a short run beside its SQL, plain updates, any partitioning."""

from __future__ import annotations

import numpy as np
import pytest

from spiketide.operators import nmf
from spiketide.plans import nmf as plans
from tests import oracle

SF = f"{oracle.ROOT}/sf0.001"


@pytest.mark.parametrize("plan, sql", [(plans.nmf_parts, plans.parts_sql), (plans.nmf_loadings, plans.loadings_sql)])
def test_short_run_beside_its_sql(spark, plan, sql):
    df = plan(spark, SF, 4, 2)
    rel = oracle.connect(SF).sql(sql(4, 2))
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert oracle._sorted(df.collect()) == oracle._sorted(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("parts", [1, 6])
def test_plain_updates_whatever_the_partitions(spark, parts, monkeypatch):
    monkeypatch.setattr(nmf, "FAN_IN", 2)
    monkeypatch.setattr(nmf, "ROWS", 7)
    draw = np.random.default_rng(1)
    v = draw.random((50, 3)) @ draw.random((3, 6))
    rows = [(k, row.tolist()) for k, row in enumerate(v)]
    odd = [(None, [1.0] * 6), (60, None), (61, [1.0]), (62, [-1.0] * 6), (63, [float("nan")] * 6), (64, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    model = nmf.Factorisation(spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(parts), "id", "v", 6)
    found = model.fit(3, 12, 2)
    for r in range(2):
        salt = 3_000 + r
        w, h = nmf.start_rows(np.arange(50), 3, salt), nmf.start_parts(3, 6, salt)
        errors = []
        for _ in range(12):
            w = w * (v @ h.T) / (w @ h @ h.T + nmf.TINY)
            h = h * (w.T @ v) / (w.T @ w @ h + nmf.TINY)
            errors.append(((v - w @ h) ** 2).sum())
        assert errors == sorted(errors, reverse=True)  # every round comes closer
        assert np.isclose(found.errors[r], errors[-1]) and np.allclose(found.history[r][-1], h)
        length = np.sqrt((w * w).sum(axis=0))
        got = np.array([x.weights for x in model.loadings(found, r).orderBy("pid").collect()])
        assert np.allclose(got, w / length) and np.allclose(got @ model.parts(found, r), w @ h)
    assert found.errors[found.best] == min(found.errors)


def test_empty_table(spark):
    model = nmf.Factorisation(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 4)
    found = model.fit(2, 3, 2)
    assert found.errors == [0.0, 0.0] and model.loadings(found, 0).collect() == []

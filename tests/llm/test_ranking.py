from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from spiketide.llm import queries, ranking
from spiketide.llm.frames import load

SF = "/root/testdata/sf0.1"


def test_pairs_separate_two_classes():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, len(ranking.FEATURES)))
    y = (x[:, 1] - x[:, 3] < 0.8).astype(int)
    got = ranking.rank(x, y)
    assert ((x @ np.array(got.weights) >= got.threshold) == (y == 1)).mean() > 0.97
    assert abs(got.quantile - (y == 0).mean()) < 0.05


def test_one_class_passes_all():
    got = ranking.rank(np.ones((5, len(ranking.FEATURES))), np.ones(5))
    assert got.weights == [0.0] * len(ranking.FEATURES)


def test_features():
    assert ranking.features_of(None) == ranking.features_of(" \n") == [0.0] * len(ranking.FEATURES)
    f = dict(zip(ranking.FEATURES, ranking.features_of("AB AB\ncd! # 12 cd!")))
    assert f["capitals"] == 2 / 6 and f["stutter"] == 1 / 6 and f["repeated_lines"] == 0


def test_odd_rows(spark):
    rows = [(1, None, 1, 2.0), (2, "", 1, 1.0), (None, "some words", 0, 1.0), (2, "", 1, 1.0), (5, "a b " * 50_000, 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, score double")
    labels = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (None, 0, "x"), (5, 0, "x"), (5, 0, "x")], "doc_id long, quality int, text string")
    fitted = ranking.fit(docs, labels, F.lit(True))
    got = ranking.score(docs, fitted).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert ranking.score(docs.limit(0), fitted).collect() == []
    unlabelled = ranking.score(docs, ranking.fit(docs, labels.limit(0), F.lit(True))).collect()
    assert all(r.predicted == 1 for r in unlabelled)


def test_every_labelled_row_counts_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    monkeypatch.setattr(ranking, "CELLS", 7)
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, len(ranking.FEATURES)))
    x[:40] = 0.0  # equal scores
    y = (x[:, 1] - x[:, 3] + draw.normal(size=600) * 0.3 < 1.6).astype(int)
    assert 0 < (y == 0).sum() < 80  # rare: copied into the buckets
    featured = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, features array<double>")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    got = ranking.fit_features(featured, labels, F.lit(True))
    again = ranking.fit_features(featured.repartition(7), labels.repartition(3), F.lit(True))
    assert np.allclose(got.weights, again.weights, rtol=1e-9) and np.isclose(got.threshold, again.threshold)
    raw = x @ np.array(got.weights)

    def cost(cut):
        return (raw[y == 1] < cut).mean() + (raw[y == 0] >= cut).mean()

    assert np.isclose(cost(got.threshold), min(cost(c) for c in [*raw, raw.max() + 1]))
    assert np.isclose((raw < got.threshold).mean(), got.quantile)
    assert ((raw >= got.threshold) == (y == 1)).mean() > 0.85


def test_a_fit_on_more_rows_than_a_bucket_uses_all(spark):
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word ', if(id % 2 = 0, '!!!', 'more')) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    seen = ranking.fit(docs, labels, F.lit(True))
    assert seen.quantile == 0.5  # a hashed sample has another share of bad rows


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op10_quality_ranking(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    assert len(got) == load(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[k].predicted, v) for k, v in labels.items() if got[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98

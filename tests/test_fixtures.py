"""Hand-computed micro-fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spiketide.functions import columns as col
from spiketide.operators import aligned, clusters, hist, inference, lagged, rates, segments, signals, sweeps
from spiketide.operators.ordered import Track
from spiketide.sources import sinks

TR = Track(("u",), "n", 3)


def series(spark, values, ddl="v bigint"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"u bigint, n bigint, {ddl}")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_interval_cv(spark):
    ev = spark.createDataFrame([(1, i, s) for i, s in enumerate((10, 20, 40, 50))], "u bigint, n bigint, step bigint")
    assert rates.interval_cv(ev, TR, "step").first()["cv"] == pytest.approx(0.353553, abs=1e-6)
    assert rates.interval_cv_compat(ev, TR, "step").first()["cv"] == pytest.approx(0.329855, abs=1e-6)
    assert rates.interval_cv(ev.limit(2), TR, "step").first()["cv"] is None


def test_runs(spark):
    out = segments.runs(series(spark, (0, 0, 1, 1, 1, 0, 3)), TR, "v")
    assert rows(out, "start", "end", "state") == [(0, 2, 0), (2, 5, 1), (5, 6, 0), (6, 7, 3)]


def test_runs_of_one_long_state(spark):
    assert rows(segments.runs(series(spark, [7] * 50), TR, "v"), "start", "end", "state") == [(0, 50, 7)]


def word_list(intervals):
    out = {}
    for s, e, state in rows(intervals, "start", "end", "state"):
        out.update({i: state for i in range(s, e)})
    return [out[i] for i in range(len(out))]


@pytest.mark.parametrize(
    "values, want",
    [
        ((5, 5, 5, 1, 1, 0, 0), [5, 5, 5, 5, 5, 0, 0]),  # into the run before
        ((1, 1, 5, 5, 5), [5, 5, 5, 5, 5]),  # into the run after
        ((0, 1, 2, 0), [0, 3, 3, 0]),  # union of its own
        ((2, 2, 2, 1, 4, 4, 4), [2, 2, 2, 1, 4, 4, 4]),  # neither neighbour holds it
        ((3, 3, 3, 1, 2, 2, 1, 3, 3, 3), [3] * 10),
    ],
)
def test_absorb(spark, values, want):
    out = segments.absorb_short(segments.runs(series(spark, values), TR, "v"), TR, 3)
    assert word_list(out) == want


def test_fill_gaps(spark):
    flags = [bool(x) for x in (0, 1, 0, 0, 1, 0, 0, 0, 1, 0)]
    out = segments.fill_gaps(series(spark, flags, "v boolean"), TR, ["v"], 2)
    assert [int(r["v"]) for r in out.orderBy("n").collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 1, 0]


def test_aligned_presence(spark):
    trig = spark.createDataFrame([(1, 100, 7)], "u bigint, t bigint, id bigint")
    resp = spark.createDataFrame([(1, t, "r") for t in (95, 100, 104, 109, 125)], "u bigint, t bigint, mark string")
    hits = aligned.presence(trig, resp, Track(("u",), "t", 4), [-5, 0, 5, 10, 15, 20], ["r"], "id")
    assert [int(r["r"]) for r in hits.orderBy("b").collect()] == [1, 1, 1, 0, 0]


def test_hist2d(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (-1.0, 0.0), (0.5, 1.5), (1.0, 2.0)], "x double, y double")
    out = hist.histogram(pts, {"bx": col.bin_of("x", 0, 1, 2), "by": col.bin_of("y", 0, 1, 2)})
    assert rows(out, "by", "bx", "n") == [(0, 0, 1), (1, 0, 1), (1, 1, 1)]


def test_index(spark):
    one = spark.range(1)
    assert one.select(col.encode_index([F.lit(1), F.lit(2), F.lit(3)], (2, 3, 4))).first()[0] == 23
    assert one.select(col.encode_index([F.lit(1), F.lit(3), F.lit(3)], (2, 3, 4))).first()[0] is None
    assert tuple(one.select(*col.decode_index(F.lit(23), (2, 3, 4))).first()) == (1, 2, 3)


def test_floor_div_is_exact(spark):
    big = 9_007_199_254_740_993
    assert spark.range(1).select(col.floor_div(F.lit(big), 1)).first()[0] == big
    assert spark.range(1).select(col.floor_div(F.lit(-7), 3)).first()[0] == -3


def test_lagged_joint(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 1), (1, 0, 0, 0)], "u bigint, n bigint, x bigint, y bigint")
    out = lagged.lagged_joint(df, TR, "x", "y", 1)
    assert rows(out, "dir", "now", "then", "src", "n") == [(0, 1, 1, 0, 1), (1, 1, 0, 1, 1)]


def samples(spark, a, b):
    return spark.createDataFrame([("g", "a", float(v)) for v in a] + [("g", "b", float(v)) for v in b], "k string, s string, v double")


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_interval_overlap(spark, limit):
    for b, want in ((range(200, 300), True), (range(50, 150), False)):
        df = samples(spark, range(1, 101), b)
        assert inference.interval_overlap(df, ["k"], "s", "a", "b", "v", direct_rows=limit).first()["differs"] is want


def test_large_quantiles_equal_builtin(spark):
    df = spark.range(20000).select(
        (F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 5 == 0, 1.5).otherwise(F.exp(F.rand(7) * 8)).alias("v"),
    ).persist()
    probs = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    want = {(r["k"], r["p"]): r["q"] for r in inference.exact_quantiles(df, ["k"], "v", probs).collect()}
    got = {(r["k"], r["p"]): r["q"] for r in inference.exact_quantiles(df, ["k"], "v", probs, direct_rows=0, cells=16).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_consensus(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a bigint, b bigint")
    out = {(r["i"], r["j"]): r["c"] for r in clusters.consensus(df, ["a", "b"]).collect()}
    assert out == {("0|0", "0|0"): 1.0, ("0|1", "0|1"): 1.0, ("1|1", "1|1"): 1.0, ("0|0", "0|1"): 0.5, ("0|1", "1|1"): 0.5}
    weighted = {(r["i"], r["j"]): r["c"] for r in clusters.consensus(df, ["a", "b"], [3.0, 1.0]).collect()}
    assert weighted[("0|0", "0|1")] == 0.75


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_silhouette(spark, block):
    df = spark.createDataFrame([(i, i // 2, [float(x)]) for i, x in enumerate((0, 1, 10, 11))], "id bigint, l bigint, v array<double>")
    s = clusters.silhouette(df, "id", "l", "v", block=block)
    got = [r["s"] for r in s.orderBy("id").collect()]
    assert got == pytest.approx([0.904762, 0.894737, 0.894737, 0.904762], abs=1e-6)
    assert s.groupBy("l").agg(F.avg("s").alias("s")).agg(F.max("s")).first()[0] == pytest.approx(0.899749, abs=1e-6)


def test_dft(spark):
    wave = [math.cos(2 * math.pi * 2 * n / 8) for n in range(8)]
    out = signals.spectrum(spark.createDataFrame([(1, wave)], "id bigint, x array<double>"), ["id"], "x")
    out = out.withColumn("f", signals.frequency("k", 8, 8.0)).withColumn("c", signals.frequency("k", 8, 8.0, compat=True))
    got = out.orderBy("k").collect()
    assert [r["amp"] for r in got] == pytest.approx([0, 0, 1, 0], abs=1e-12)
    assert [r["f"] for r in got] == [0, 1, 2, 3]
    assert [r["c"] for r in got] == pytest.approx([0, 4 / 3, 8 / 3, 4])


def test_sweep_weights(spark):
    df = spark.createDataFrame([(-0.3,), (0.0,), (0.85,)], "wx double")
    got = [tuple(r) for r in df.select(*sweeps.path_weights("wx")).collect()]
    assert [x for r in got for x in r] == pytest.approx([0.7, 1, 1, 1, 1, 0.15])


def test_state_word(spark):
    flags = [F.lit(False), F.lit(True), F.lit(False), F.lit(True)]
    assert spark.range(1).select(segments.state_word(flags)).first()[0] == 10


def test_pair_synchrony(spark):
    df = spark.createDataFrame([("A", 1, 0), ("A", 1, 1), ("B", 2, 1), ("B", 2, 2)], "pop string, u bigint, b bigint")
    out = {(r["pop_i"], r["pop_j"]): r["sync"] for r in rates.pair_synchrony(df, "pop", "u", "b").collect()}
    assert out[("A", "B")] == pytest.approx(0.5)
    assert out[("A", "A")] == pytest.approx(1.0)


def test_chi_of_identical_series(spark):
    df = spark.createDataFrame([("A", u, h, c) for u in (1, 2) for h, c in ((0, 1), (1, 4), (3, 2))], "pop string, u bigint, h bigint, c bigint")
    assert rates.chi_synchrony(df, "pop", "u", "h", 5).first()["chi"] == pytest.approx(1.0)


def test_total_signal(spark):
    df = spark.createDataFrame([(0, 800, 1.0), (0, 200, 2.0)], "n bigint, size bigint, v double")
    assert sinks.total_signal(df, ["n"], "size", "v").first()["v"] == pytest.approx(1.2)


def test_gated_contingency(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.2), (2, 2, 0.9)], "a bigint, b bigint, s double")
    assert rows(hist.contingency(df, "a", "b", gate=F.col("s") > 0.2), "a", "b", "n") == [(1, 1, 1), (2, 2, 1)]


def test_mirrored_smoothing(spark):
    import numpy as np

    x = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    taps = col.gaussian_taps(1.0, 3)
    length = spark.createDataFrame([(1, len(x))], "u bigint, length bigint")
    got = segments.smooth(series(spark, [float(v) for v in x], "v double"), TR, "v", taps, length)
    pad = np.pad(x, 3, mode="symmetric")
    want = [float(np.dot(taps, pad[i : i + 7])) for i in range(len(x))]
    assert [r["smooth"] for r in got.orderBy("n").collect()] == pytest.approx(want)


def test_t_p_values(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (1.959964, 1e6), (12.7062, 1.0)], "t double, dof double")
    got = [r[0] for r in df.select(inference.t_p_value("t", "dof")).collect()]
    assert got == pytest.approx([0.05, 1.0, 0.05, 0.05], abs=1e-5)


def test_lorentz(spark):
    from spiketide.functions import spectral

    f = [float(i) for i in range(60)]
    y = [3.0 / (1 + ((x - 22.3) / 4.5) ** 2) for x in f]
    df = spark.createDataFrame([(f, y)], "f array<double>, y array<double>")
    r = df.select(spectral.lorentz_fit("f", "y").alias("p")).select("p.*").first()
    assert (r["centre"], r["width"], r["height"]) == pytest.approx((22.3, 4.5, 3.0), rel=1e-6)
    assert (r["lo"], r["hi"]) == (20.05, 24.55)


def test_one_hot_unit_with_most_rows(spark):
    """A unit holding nearly all rows gives the same runs as a plain loop."""
    import random

    rng = random.Random(3)
    data = [(1, i, rng.randrange(3)) for i in range(900)] + [(2, i, rng.randrange(3)) for i in range(20)]
    df = spark.createDataFrame(data, "u bigint, n bigint, v bigint")
    got = rows(segments.runs(df, TR.at("n", width=7), "v"), "u", "start", "end", "state")
    want = []
    for u in (1, 2):
        vals = [v for k, _, v in data if k == u]
        start = 0
        for i in range(1, len(vals) + 1):
            if i == len(vals) or vals[i] != vals[start]:
                want.append((u, start, i, vals[start]))
                start = i
    assert got == sorted(want)


def test_components_of_a_long_path(spark):
    from spiketide.operators import graphs

    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)]
    e = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a bigint, b bigint")
    n = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 200]], "a bigint")
    got = dict(tuple(r) for r in graphs.components(n, e).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_random_edges(spark):
    from spiketide.operators import graphs

    posts = spark.range(40).withColumnRenamed("id", "post")
    pres = spark.range(0, 4000, 100).withColumnRenamed("id", "pre")
    got = [tuple(r) for r in graphs.random_edges(posts, pres, 6, seed=1).collect()]
    assert len(got) == len(set(got)) == 240
    assert all(a != b and a % 100 == 0 and 0 <= a < 4000 for a, b in got)
    full = graphs.random_edges(posts, posts.withColumnRenamed("post", "pre"), 100, seed=1)
    assert full.count() == 40 * 39
    assert graphs.random_edges(posts, pres.limit(0), 3, seed=1).count() == 0


def test_random_edges_are_spread(spark):
    from spiketide.operators import graphs

    posts = spark.range(400).withColumnRenamed("id", "post")
    got = graphs.random_edges(posts, posts.withColumnRenamed("post", "pre"), 5, seed=2).collect()
    by_post: dict[int, list[int]] = {}
    for a, b in got:
        by_post.setdefault(b, []).append(a)
    steps = [y - x for s in by_post.values() for x, y in zip(sorted(s), sorted(s)[1:])]
    assert sum(d == 1 for d in steps) < 0.05 * len(steps)
    counts = [sum(a == k for a, _ in got) for k in range(400)]
    assert 0 < max(counts) < 20 and sum(counts) == 2000


def test_scatter_takes_any_id(spark):
    from spiketide.operators import aligned

    ids = [0, 1, 4_000_000_000, 2**62, -5]
    df = spark.createDataFrame([(i,) for i in ids], "u bigint")
    got = [r[0] for r in df.select(aligned.scatter("u", 3)).collect()]
    assert got == [((i % 2**32) * 2654435761 + 3 * 97531) % 2**32 for i in ids]


def test_cross_pairs_of_either_sign(spark):
    from spiketide.operators import lagged
    from spiketide.operators.ordered import Track

    x, y = [1.0, 5.0, 2.0, 8.0, 3.0], [2.0, 1.0, 7.0, 4.0, 9.0]
    df = spark.createDataFrame([(0, n, a, b) for n, (a, b) in enumerate(zip(x, y))], "u int, n bigint, x double, y double")
    for track in (Track(("u",), "n", 3), Track(("u",), "n", 3, flat=True)):
        got = {r.lag: (r.n, r.sab) for r in lagged.lagged_pairs(df, track, "x", "y", range(-2, 3)).collect()}
        for lag in range(-2, 3):
            pairs = [(x[n], y[n + lag]) for n in range(5) if 0 <= n + lag < 5]
            assert got[lag] == (len(pairs), sum(a * b for a, b in pairs))


def test_hills(spark):
    from spiketide.operators import replicates

    def run(v, **kw):
        df = spark.createDataFrame([([float(x) for x in v],)], "v array<double>")
        return [tuple(h) for h in df.select(replicates.hills("v", **kw).alias("h")).first()["h"]]

    assert run((0, 2, 1, 3, 0)) == [(1, 0, 1), (3, 2, 4)]
    # the shoulder of five falling points at the left is a hill of its own
    assert run((5, 4, 3, 2, 1, 4, 0)) == [(0, 0, 3), (5, 4, 6)]
    assert run((1, 2, 3)) == [(2, 0, 2)]
    # the small bump is not prominent enough, its two points join the hill beside them
    assert run((0, 1.0, 0.9995, 1.5, 0)) == [(3, 0, 4)]


def test_barcode(spark):
    from spiketide.operators import replicates

    curve = [0, 0, 1, 4, 1, 0, 0, 0]
    df = spark.createDataFrame([(0, 2 + i, float(v), 0.5, v > 0) for i, v in enumerate(curve)], "dir bigint, lag bigint, true_mean double, surr_mean double, differs boolean")
    none = replicates.barcode(df, 8)
    assert none.count() == 10 and none.filter("code <> 0").count() == 0
    sure = replicates.barcode(df.withColumn("differs", F.lit(True)), 8)
    got = {r["lag"]: r["code"] for r in sure.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0.5, 5: 3.5, 6: 0.5, 7: 0, 8: 0, 9: 0}
    pct = replicates.barcode(df.withColumn("differs", F.lit(True)), 8, percent=True)
    assert {r["lag"]: r["code"] for r in pct.collect()}[5] == 87.5


def test_principal_axes_and_correlated_features(spark):
    df = spark.range(500).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.col("a") * 2 + 1)
    axes = clusters.principal_axes(df, ["a", "b", "c"]).orderBy("axis").collect()
    assert axes[0]["share"] == pytest.approx(2 / 3, abs=0.05) and axes[2]["cumulative"] == pytest.approx(1.0)
    assert clusters.uncorrelated_features(df, ["a", "b", "c"], 0.9) == ["a", "b"]


def test_weighted_denoise(spark):
    cells = spark.createDataFrame([(r, c, 0, 1.0) for r in range(3) for c in range(3)], "r bigint, c bigint, state bigint, s double")
    odd = cells.withColumn("state", F.when((F.col("r") == 1) & (F.col("c") == 1), 5).otherwise(F.col("r"))).withColumn("s", F.when(F.col("r") == 2, 9.0).otherwise(1.0))
    got = {(r["r"], r["c"]): r["state"] for r in clusters.majority_denoise(odd, weight="s").collect()}
    assert got[(1, 1)] == 2


def test_cut_chunks(spark):
    pts = series(spark, range(12), "x bigint")
    iv = spark.createDataFrame([(1, 3, 6, 4), (1, 6, 9, 2)], "u bigint, start bigint, end bigint, state bigint")
    got = rows(segments.cut_chunks(pts, iv, TR, lead_in=2), "state", "k", "x")
    assert got == [(2, k, 6 + k) for k in range(-2, 3)] + [(4, k, 3 + k) for k in range(-2, 3)]


def test_half_samples_of_many_rounds(spark):
    from spiketide.operators import replicates

    rounds = 100
    units = spark.range(300).select(F.col("id").alias("u"), F.lit(1).cast("bigint").alias("n"))
    masked = units.withColumn("mask", replicates.membership(rounds, "u")).groupBy("mask").agg(F.sum("n").alias("n"))
    got = {r.round: r.n for r in replicates.half_samples(masked, "mask", rounds).collect()}
    assert set(got) == set(range(rounds)) and all(100 < n < 200 for n in got.values()) and len(set(got.values())) > 10


def test_small_expressions(spark):
    from spiketide.functions.columns import linspace, logistic
    from spiketide.operators.sweeps import mean_degrees

    out, back = mean_degrees(F.lit(0.1), F.lit(800), F.lit(200))
    r = spark.range(1).select(linspace(1, 2, 5).alias("a"), linspace(3, 9, 1).alias("b"), logistic(F.lit(2.0), 3.0, 2.0).alias("c"), out.alias("d"), back.alias("e")).first()
    assert (r.a, r.b, r.c) == ([1.0, 1.25, 1.5, 1.75, 2.0], [3.0], 0.5)
    assert abs(r.d - 20) < 1e-9 and abs(r.e - 80) < 1e-9


def test_adjusted_mutual_info_of_many_rows(spark):
    import time

    from spiketide.operators import hist

    table = spark.createDataFrame([(0, 0, 3_000_000), (0, 1, 2_000_000), (1, 0, 1_500_000), (1, 1, 3_500_000)], "a int, b int, n bigint")
    start = time.time()
    r = hist.adjusted_mutual_info(table, "a", "b").first()
    assert time.time() - start < 60
    assert 0 < r.emi < 1e-6 and abs(r.ami - r.mi / 0.6909) < 0.002


def test_labels_couplings_and_lookups(spark):
    from spiketide.functions.columns import in_band, motif_flags, period_ms
    from spiketide.operators import sweeps

    df = spark.createDataFrame([("F(fs)S(fs)",), ("F(--)S(-s)",), ("S(fs)",), (None,)], "lb string")
    assert [r[0] for r in df.select(motif_flags("lb")).collect()] == [[1, 1, 1, 1], [0, 0, 0, 1], None, None]
    f = spark.createDataFrame([(60.0, "F"), (45.0, "F"), (30.0, "S"), (0.0, "x"), (None, "S")], "f double, pop string")
    got = f.select(in_band("f", "pop", {"F": (50.0, None), "S": (None, 40.0)}).alias("b"), period_ms("f").alias("p")).collect()
    assert [r.b for r in got] == [True, False, True, None, None]
    assert [round(r.p, 3) for r in got] == [16.667, 22.222, 33.333, 30.0, 30.0]
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, None), (2, 3, float("inf")), (3, 4, float("nan"))], "pre int, post int, w double")
    assert sorted(r.pre for r in sweeps.unset_couplings(e).collect()) == [1, 2, 3]
    jobs = sweeps.expand(spark, {"alpha": [0.0, 1.0], "beta": [0.5, 0.7]})
    named = {r["name"]: r["value"] for r in sweeps.job_parameters(jobs.select("job_id", "alpha", "beta"), 2).collect()}
    assert named == {"alpha": 1.0, "beta": 0.5}


def test_random_edges_of_few_sources_do_not_run_out(spark):
    from spiketide.operators import graphs

    posts = spark.range(3000).withColumnRenamed("id", "post")
    two = posts.filter("post < 2").withColumnRenamed("post", "pre")
    got = {}
    for a, b in graphs.random_edges(posts, two, 2, seed=3).collect():
        got.setdefault(b, set()).add(a)
    assert got == {k: {0, 1} - {k} for k in range(3000)}
    seven = posts.filter("post < 7").withColumnRenamed("post", "pre")
    eight = posts.filter("post < 8").withColumnRenamed("post", "pre")
    assert all(len(set(s)) == 7 - (b < 7) for b, s in _by_post(graphs.random_edges(posts, seven, 7, seed=4)).items())
    same = _by_post(graphs.random_edges(posts.repartition(7), eight, 3, seed=4)) == _by_post(graphs.random_edges(posts, eight, 3, seed=4))
    assert same


def _by_post(edges) -> dict:
    out: dict = {}
    for a, b in edges.orderBy("post", "pre").collect():
        out.setdefault(b, []).append(a)
    return out


def test_row_counts_follow_the_data(spark, tmp_path):
    from spiketide.plans import tables

    path = f"{tmp_path}/events.parquet"
    spark.range(5).write.parquet(path)
    assert tables.row_count(spark, str(tmp_path), "events") == 5
    spark.range(7).write.mode("append").parquet(path)
    assert tables.row_count(spark, str(tmp_path), "events") == 12

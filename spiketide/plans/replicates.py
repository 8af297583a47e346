"""Queries: replicated transfer entropy, its tests and barcodes, graph clusters, feature cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import aligned, clusters, graphs, lagged, replicates, rotations, segments, signals
from spiketide.operators.ordered import Track
from spiketide.plans.clusters import CONSENSUS, labelings
from spiketide.plans.joins import BINNED, EDGES, PROBE, _binned, _responses, event_response, event_response_control, time_track
from spiketide.plans.rates import EV, POP, SER, pop_of, run_summary
from spiketide.plans.registry import SQL, query
from spiketide.plans.segments import CHAIN, motifs
from spiketide.plans.signals import DFT, vectors
from spiketide.plans.tables import HOUR, event_track, events, series, table
from spiketide.session import stage

LAGS, ROUNDS = 6, 100

JOINT = f"""pr AS (SELECT a.u, b.n - a.n AS lag, a.xb AS x0, a.yb AS y0, b.xb AS x1, b.yb AS y1
      FROM bn a JOIN bn b ON a.u = b.u AND b.n - a.n BETWEEN 1 AND {LAGS}),
    lj AS (SELECT u, lag, 0::BIGINT AS dir, y1 AS now, y0 AS "then", x0 AS src, count(*) AS n FROM pr GROUP BY ALL
      UNION ALL SELECT u, lag, 1::BIGINT, x1, x0, y0, count(*) FROM pr GROUP BY ALL),
    hs AS (SELECT r.r AS round, lag, dir, now, "then", src, sum(n) AS n FROM lj JOIN range(0, {ROUNDS}) r(r)
      ON (('0x' || substr(md5(lj.u || CASE WHEN r.r < 32 THEN '' ELSE ':' || (r.r // 32) END), 1, 8))::BIGINT >> (r.r % 32)) & 1 = 1 GROUP BY ALL)"""


def te_sql(out: str, src: str) -> str:
    return f"""{out}_m AS (SELECT round, lag, dir, n, sum(n) OVER (PARTITION BY round, lag, dir) AS a, sum(n) OVER (PARTITION BY round, lag, dir, "then") AS c,
      sum(n) OVER (PARTITION BY round, lag, dir, "then", src) AS cs, sum(n) OVER (PARTITION BY round, lag, dir, now, "then") AS nc FROM {src}),
    {out} AS (SELECT round, lag, dir, sum(n / a * log2(n * c / (cs * nc))) AS te FROM {out}_m GROUP BY round, lag, dir)"""


ROTATED = f"""ln AS (SELECT *, count(*) OVER (PARTITION BY u) AS len FROM bn),
    cp AS (SELECT u, r.r AS round, n, xb, yb, len, ((n - ('0x' || substr(md5(u || ':' || r.r), 1, 8))::BIGINT % len) % len + len) % len AS m
      FROM ln CROSS JOIN range(0, {ROUNDS}) r(r)),
    sh AS (SELECT a.u, a.round, a.n, b.xb, a.yb FROM cp a JOIN cp b ON a.u = b.u AND a.round = b.round AND a.n = b.m)"""
SURR = f"""{ROTATED},
    sp AS (SELECT a.round, b.n - a.n AS lag, a.xb AS x0, a.yb AS y0, b.xb AS x1, b.yb AS y1
      FROM sh a JOIN sh b ON a.u = b.u AND a.round = b.round AND b.n - a.n BETWEEN 1 AND {LAGS}),
    sj AS (SELECT round, lag, 0::BIGINT AS dir, y1 AS now, y0 AS "then", x0 AS src, count(*) AS n FROM sp GROUP BY ALL
      UNION ALL SELECT round, lag, 1::BIGINT, x1, x0, y0, count(*) FROM sp GROUP BY ALL)"""

BY = ["round", "lag", "dir"]


def te_rounds(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = _binned(spark, sf)
    masked = df.withColumn("mask", replicates.membership(ROUNDS, "u"))
    per_mask = lagged.lagged_joint(masked, tr, "xb", "yb", LAGS, by=["mask"])
    return lagged.transfer_entropy(replicates.half_samples(per_mask, "mask", ROUNDS), BY)


def te_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = _binned(spark, sf)
    return lagged.transfer_entropy(rotations.rotated_counts(stage(df), tr, "xb", "yb", LAGS, ROUNDS), BY)


@query("te_half_samples", f"WITH {BINNED}, {JOINT}, {te_sql('te', 'hs')} SELECT round, lag, dir, round(te, 8) AS te FROM te")
def te_half_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer entropy of random halves of the units."""
    return te_rounds(spark, sf).withColumn("te", rounded("te", 8))


@query("te_shift_surrogates", f"WITH {BINNED}, {SURR}, {te_sql('te', 'sj')} SELECT round, lag, dir, round(te, 8) AS te FROM te")
def te_shift_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer entropy after rotating one signal against the other."""
    return te_surrogates(spark, sf).withColumn("te", rounded("te", 8))


def te_tests(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.compare_replicates(te_rounds(spark, sf), te_surrogates(spark, sf), ["dir", "lag"], "te", 0.05, 0.95)


@query(
    "te_stat_test",
    f"""WITH {BINNED}, {JOINT}, {te_sql('tt', 'hs')}, {SURR}, {te_sql('ts', 'sj')},
    a AS (SELECT dir, lag, avg(te) AS m, quantile_cont(te, 0.05) AS lo, quantile_cont(te, 0.95) AS hi FROM tt GROUP BY 1, 2),
    b AS (SELECT dir, lag, avg(te) AS m, quantile_cont(te, 0.05) AS lo, quantile_cont(te, 0.95) AS hi FROM ts GROUP BY 1, 2)
    SELECT dir, lag, round(a.m, 8) AS true_mean, round(b.m, 8) AS surr_mean, a.lo > b.hi OR a.hi < b.lo AS differs FROM a JOIN b USING (dir, lag)""",
)
def te_stat_test(spark: SparkSession, sf: str) -> DataFrame:
    """Interval test of true against surrogate estimates on the (direction, lag) grid."""
    t = te_tests(spark, sf)
    return t.select("dir", "lag", rounded("true_mean", 8).alias("true_mean"), rounded("surr_mean", 8).alias("surr_mean"), "differs")


@query("te_barcode")
def te_barcode(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.barcode(stage(te_tests(spark, sf)), LAGS)


@query(
    "spectrum_hills",
    f"""WITH {DFT}, m AS (SELECT label, k, avg(amp) AS v FROM a GROUP BY 1, 2),
    nb AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM m WINDOW w AS (PARTITION BY label ORDER BY k)),
    pk AS (SELECT label, k AS p, v FROM nb WHERE v > l AND v > r),
    sd AS (SELECT pk.label, p, pk.v, (SELECT coalesce(max(k), -1) FROM m WHERE m.label = pk.label AND m.k < p AND m.v > pk.v) AS lh,
      (SELECT coalesce(min(k), 99) FROM m WHERE m.label = pk.label AND m.k > p AND m.v > pk.v) AS rh FROM pk),
    pr AS (SELECT label, p, v, v - greatest((SELECT min(m.v) FROM m WHERE m.label = sd.label AND m.k > lh AND m.k < p),
      (SELECT min(m.v) FROM m WHERE m.label = sd.label AND m.k > p AND m.k < rh)) AS prom FROM sd),
    h AS (SELECT label, p, (SELECT max(k) FROM nb WHERE nb.label = pr.label AND nb.k <= p AND (nb.l IS NULL OR nb.l > nb.v)) AS f,
      (SELECT min(k) FROM nb WHERE nb.label = pr.label AND nb.k >= p AND (nb.r IS NULL OR nb.r > nb.v)) AS e FROM pr WHERE prom >= 0.001),
    h2 AS (SELECT label, p, f, CASE WHEN lead(f) OVER w <= e THEN lead(f) OVER w - 1 ELSE e END AS e,
      row_number() OVER w AS i, count(*) OVER (PARTITION BY label) AS n FROM h WINDOW w AS (PARTITION BY label ORDER BY p)),
    h3 AS (SELECT label, p, CASE WHEN i = 1 AND f < 4 THEN 0 ELSE f END AS f, CASE WHEN i = n AND 31 - e < 4 THEN 31 ELSE e END AS e, i, n FROM h2),
    ends AS (SELECT label, 0 AS f, f - 1 AS e FROM h3 WHERE i = 1 AND f > 0 UNION ALL SELECT label, e + 1, 31 FROM h3 WHERE i = n AND e < 31
      UNION ALL SELECT label, 0, 31 FROM (SELECT DISTINCT label FROM m) WHERE label NOT IN (SELECT label FROM h3)),
    x AS (SELECT ends.label, arg_max(k, v) AS p, f, e FROM ends JOIN m ON m.label = ends.label AND m.k BETWEEN f AND e GROUP BY ends.label, f, e)
    SELECT label, p::INTEGER AS peak, f::INTEGER AS "first", e::INTEGER AS "last" FROM h3 UNION ALL SELECT label, p::INTEGER, f::INTEGER, e::INTEGER FROM x""",
)
def spectrum_hills(spark: SparkSession, sf: str) -> DataFrame:
    """Hills of the mean spectrum of each label (32 points per label)."""
    mean = signals.spectrum(vectors(spark, sf), ["label"], "embedding").groupBy("label", "k").agg(F.avg("amp").alias("m"))
    curve = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c"))
    return curve.select("label", F.inline(replicates.hills(F.col("c.m"))))


@query(
    "peaked_significant_runs",
    f"""WITH {EV}, o AS (SELECT kind, ((t - 1704067200000000) // {HOUR}) % 24 AS lag, avg(x) AS v FROM ev GROUP BY 1, 2),
    g AS (SELECT *, avg(v) OVER (PARTITION BY kind) AS m FROM o),
    s AS (SELECT kind, lag, lag - row_number() OVER (PARTITION BY kind ORDER BY lag) AS g FROM g WHERE v > m),
    r AS (SELECT kind, min(lag) AS s, max(lag) + 1 AS e FROM s GROUP BY kind, g),
    x AS (SELECT kind, lag, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY kind ORDER BY lag)),
    d AS (SELECT o.kind, o.lag, coalesce(min(abs(o.lag - x.lag)) FILTER (x.v > a AND x.v > b), 1e9) AS p,
      coalesce(min(abs(o.lag - x.lag)) FILTER (x.v < a AND x.v < b), 1e9) AS t FROM o JOIN x USING (kind) GROUP BY 1, 2)
    SELECT r.kind, r.s AS "start", r.e AS "end", count(*) FILTER (p < t) AS near FROM r JOIN d ON d.kind = r.kind AND d.lag >= r.s AND d.lag < r.e
    GROUP BY 1, 2, 3 HAVING count(*) FILTER (p < t) > count(*) * 0.1""",
)
def peaked_significant_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Hours above the mean that cluster around peaks of the daily curve."""
    hod = F.expr(f"((t - 1704067200000000) div {HOUR}) % 24")
    curve = stage(events(spark, sf).groupBy("kind", hod.alias("lag")).agg(F.avg("x").alias("v")))
    mean = curve.groupBy("kind").agg(F.avg("v").alias("m"))
    high = curve.join(mean, "kind").select("kind", "lag", (F.col("v") > F.col("m")).cast("bigint").alias("s"))
    runs = segments.runs(high, Track(("kind",), "lag", 64, flat=True), "s").filter("state = 1")
    return replicates.peaked_runs(runs, curve, ["kind"])


@query(
    "consensus_clusters",
    f"""{CONSENSUS.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT i AS a, j AS b FROM cm WHERE c >= 0.6 UNION SELECT j, i FROM cm WHERE c >= 0.6),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
    SELECT a AS sig, min(b) AS cluster FROM reach GROUP BY a""",
)
def consensus_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures that a chain of co-memberships of at least 0.6 holds together."""
    return graphs.threshold_clusters(clusters.consensus(labelings(spark, sf), ["r0", "r1", "r2"]), 0.6)


@query(
    "random_edges",
    """WITH s AS (SELECT s_suppkey AS pre, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
    d AS (SELECT p_partkey AS post, j.j, (SELECT max(n) FROM s) AS n FROM part CROSS JOIN range(0, 640) j(j)),
    h AS (SELECT post, j, ('0x' || substr(md5(post || ':' || j || ':11'), 1, 8))::BIGINT % n AS i FROM d),
    f AS (SELECT post, i, min(j) AS j FROM h GROUP BY post, i),
    r AS (SELECT post, pre, row_number() OVER (PARTITION BY post ORDER BY j) AS k FROM f JOIN s USING (i) WHERE pre <> post)
    SELECT pre, post FROM r WHERE k <= 5""",
)
def random_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Random graph of fixed in-degree 5 from suppliers to parts."""
    pres = table(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("pre"))
    posts = table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("post"))
    return graphs.random_edges(posts, pres, 5, seed=11)


@query(
    "response_peak",
    f"""WITH r AS ({SQL['event_response']}), c AS ({SQL['event_response_control']}), d AS (SELECT r.b, r.prob, r.prob - c.prob AS d FROM r JOIN c USING (b)),
    s AS (SELECT b, prob, 0.25 * lag(d) OVER w + 0.5 * d + 0.25 * lead(d) OVER w AS s FROM d WINDOW w AS (ORDER BY b))
    SELECT arg_max(b, s) AS b, round(max(s), 9) AS diff, arg_max(prob, s) AS prob FROM s""",
)
def response_peak(spark: SparkSession, sf: str) -> DataFrame:
    """Bin in which the smoothed excess over the control is largest, and the response there."""
    r = event_response(spark, sf).select("b", "prob")
    c = event_response_control(spark, sf).select("b", F.col("prob").alias("prob0"))
    d = r.join(c, "b").select(F.lit(0).alias("g"), "b", "prob", (F.col("prob") - F.col("prob0")).alias("d"))
    w = segments.W.partitionBy("g").orderBy("b")  # 24 bins
    s = d.withColumn("s", 0.25 * F.lag("d").over(w) + 0.5 * F.col("d") + 0.25 * F.lead("d").over(w)).filter("s IS NOT NULL")
    return s.agg(F.max_by("b", "s").alias("b"), rounded(F.max("s"), 9).alias("diff"), F.max_by("prob", "s").alias("prob"))


@query(
    "motif_chunks",
    f"""{CHAIN}, iv AS (SELECT u, "start" AS s, "end" AS e, state FROM ab WHERE state <> 0 AND "end" - "start" >= 3)
    SELECT iv.state, ser.n - iv.s AS k, count(*) AS n, round(avg(x), 9) AS m FROM ser JOIN iv ON iv.u = ser.u AND ser.n >= iv.s - 2 AND ser.n < iv.e
    GROUP BY 1, 2""",
)
def motif_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Signal cut by motif, two samples of lead-in included, averaged by place in the chunk."""
    ser, tr = series(spark, sf, "x")
    iv = stage(motifs(spark, sf).filter("state <> 0 AND end - start >= 3"))
    chunks = segments.cut_chunks(stage(ser.select("u", "n", "x")), iv, tr, lead_in=2)
    return chunks.groupBy("state", "k").agg(F.count("*").alias("n"), rounded(F.avg("x"), 9).alias("m"))


@query(
    "burst_table",
    """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS n FROM embeddings),
    f AS (SELECT vec_id, f.f AS frame, n - f.f * 4 AS m, v * (0.5 - 0.5 * cos(2 * pi() * (n - f.f * 4) / 15)) AS v
      FROM s JOIN range(0, 12) f(f) ON n >= f.f * 4 AND n < f.f * 4 + 16),
    y AS (SELECT vec_id, frame, k.k, sum(v * cos(2 * pi() * k.k * m / 16)) AS re, sum(v * sin(2 * pi() * k.k * m / 16)) AS im
      FROM f CROSS JOIN range(1, 7) k(k) GROUP BY ALL),
    a AS (SELECT vec_id, frame, CASE WHEN k <= 2 THEN 0 ELSE 1 END::BIGINT AS band, k, 2.0 / 16 * sqrt(re * re + im * im) AS amp FROM y),
    b AS (SELECT vec_id, band, frame, max(amp) AS amp, arg_max(k, amp) AS k FROM a GROUP BY 1, 2, 3),
    q AS (SELECT band, quantile_cont(amp, 0.75) AS q FROM b GROUP BY band),
    h AS (SELECT vec_id, band, frame, b.amp, k, frame - row_number() OVER (PARTITION BY vec_id, band ORDER BY frame) AS g FROM b JOIN q USING (band) WHERE amp > q)
    SELECT vec_id, band, min(frame) AS n0, max(frame) + 1 AS n1, count(*) AS len, round(avg(k), 6) AS f, round(avg(amp), 7) AS amp FROM h
    GROUP BY vec_id, band, g HAVING count(*) * 4 / 64.0 >= 3 / (avg(k) * 4)""",
)
def burst_table(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts per band: frames above the band's own 75 percent level, at least three cycles long."""
    from spiketide.operators.bursts import band_bursts

    spec = signals.stft(vectors(spark, sf), ["vec_id"], "embedding", 16, 4).filter("k BETWEEN 1 AND 6")
    band = F.when(F.col("k") <= 2, 0).otherwise(1).cast("bigint")
    out = band_bursts(spec.withColumn("band", band), ["vec_id"], level=0.75, frame_time=4 / 64, hz=4.0)
    return out.select("vec_id", "band", "n0", "n1", "len", rounded("f").alias("f"), rounded("amp", 7).alias("amp"))


@query(
    "feature_cube",
    f"""WITH r AS ({SQL['run_summary']}), a AS (SELECT u, first_lag, large_lag, large FROM ({SQL['autocorr_peaks']})),
    ap AS (SELECT {POP} AS pop, large_lag AS tau, large AS mag FROM a)
    SELECT 'chi' AS "key", pop, 'mean' AS type, chi AS value FROM r UNION ALL SELECT 'cv', pop, 'mean', cv FROM r
    UNION ALL SELECT 'frs_m', pop, 'mean', frs_m FROM r UNION ALL SELECT 'frs_s', pop, 'mean', frs_s FROM r
    UNION ALL SELECT 'tau', pop, 'mean', round(avg(tau), 9) FROM ap GROUP BY pop UNION ALL SELECT 'tau', pop, 'var', round(var_pop(tau), 9) FROM ap GROUP BY pop
    UNION ALL SELECT 'mag', pop, 'mean', round(avg(mag), 3) FROM ap GROUP BY pop UNION ALL SELECT 'mag', pop, 'std', round(stddev_pop(mag), 3) FROM ap GROUP BY pop""",
)
def feature_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Order parameters and dynamic features in one long table, coordinates as columns."""
    from spiketide.plans.signals import autocorr_peaks

    def long(df: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.col(c).alias("value")) for c, (k, t) in kinds.items()])
        return df.select("pop", F.inline(rows)).select("key", "pop", "type", "value")

    order = long(run_summary(spark, sf), {c: (c, "mean") for c in ("chi", "cv", "frs_m", "frs_s")})
    ac = autocorr_peaks(spark, sf).groupBy(pop_of().alias("pop")).agg(
        rounded(F.avg("large_lag"), 9).alias("a"), rounded(F.var_pop("large_lag"), 9).alias("b"),
        rounded(F.avg("large"), 3).alias("c"), rounded(F.stddev_pop("large"), 3).alias("d"),
    )
    dyna = long(ac, {"a": ("tau", "mean"), "b": ("tau", "var"), "c": ("mag", "mean"), "d": ("mag", "std")})
    return order.unionByName(dyna)


@query(
    "phase_lag",
    f"""WITH cc AS ({SQL['cross_corr']}), ac AS ({SQL['autocorr_peaks']}), t AS (SELECT u, arg_max(lag, {{'c': c, 'near': -abs(lag), 'lag': lag}}) AS tau FROM cc GROUP BY u),
    c AS (SELECT {POP} AS pop, ((tau % large_lag) + large_lag) % large_lag / large_lag AS c FROM t JOIN ac USING (u)),
    p AS (SELECT pop, CASE WHEN c > 0.5 THEN c - 1 ELSE c END AS c, 2 * pi() * c AS p FROM c)
    SELECT pop, count(*) AS n, round(avg(c), 6) AS cycles, round(atan2(avg(sin(p)), avg(cos(p))), 6) AS phase, round(1 - (avg(cos(p)) ** 2 + avg(sin(p)) ** 2), 6) AS dispersion FROM p GROUP BY pop""",
)
def phase_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Lag of the strongest cross-correlation, of either sign, in cycles of the own period within (-0.5, 0.5], and its mean phase."""
    from spiketide.functions.columns import circular_dispersion, circular_mean
    from spiketide.plans.joins import cross_corr
    from spiketide.plans.signals import autocorr_peaks

    best = F.struct("c", -F.abs(F.col("lag")), "lag")  # of equal correlations the shortest lag
    tau = cross_corr(spark, sf).groupBy("u").agg(F.max_by("lag", best).alias("tau"))
    period = autocorr_peaks(spark, sf).select("u", "large_lag")
    c = F.pmod(F.col("tau"), F.col("large_lag")) / F.col("large_lag")
    ph = tau.join(period, "u").select(pop_of().alias("pop"), F.when(c > 0.5, c - 1).otherwise(c).alias("c"))
    ph = ph.withColumn("p", F.lit(2.0) * F.pi() * F.col("c"))
    return ph.groupBy("pop").agg(
        F.count("*").alias("n"), rounded(F.avg("c")).alias("cycles"), rounded(circular_mean(F.col("p"))).alias("phase"), rounded(circular_dispersion(F.col("p"))).alias("dispersion")
    )


SAVGOL = (-2 / 21, 3 / 21, 6 / 21, 7 / 21, 6 / 21, 3 / 21, -2 / 21)  # fixed values: 7 points, order 2


@query(
    "savgol_smooth",
    f"""WITH {SER}, k(j, w) AS (VALUES {', '.join(f'({j}, {w!r}::DOUBLE)' for j, w in zip(range(-3, 4), SAVGOL))})
    SELECT a.u, a.n, round(sum(b.x * k.w), 6) AS smooth FROM ser a CROSS JOIN k JOIN ser b ON b.u = a.u AND b.n = a.n + k.j
    GROUP BY a.u, a.n HAVING count(*) = 7""",
)
def savgol_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Local quadratic smoothing, inner samples."""
    ser, tr = series(spark, sf, "x")
    return segments.smooth(ser, tr, "x", SAVGOL).select("u", "n", rounded("smooth").alias("smooth"))


@query(
    "linear_interpolation",
    f"""WITH {EV}, k AS (SELECT u, t, x, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM ev WINDOW w AS (PARTITION BY u ORDER BY event_id)),
    h AS (SELECT 1704067200000000 + i * {HOUR} AS g FROM range(0, 721) r(i))
    SELECT u, h.g AS t, round(x + (x1 - x) * (h.g - t) / (t1 - t), 6) AS x FROM k JOIN h ON h.g >= k.t AND h.g < k.t1""",
)
def linear_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit's signal on the full hours, interpolated between its events."""
    ev = events(spark, sf).select("u", "event_id", "t", "x")
    return segments.resample(ev, event_track(spark, sf), "t", "x", HOUR).withColumn("x", rounded("x"))


@query(
    "cooccurrence_significance",
    f"""WITH {BINNED}, {ROTATED},
    o AS (SELECT xb, yb, count(*) AS n FROM bn GROUP BY 1, 2), c AS (SELECT round, xb, yb, count(*) AS n FROM sh GROUP BY 1, 2, 3),
    g AS (SELECT o.xb, o.yb, o.n, coalesce(c.n, 0) AS m FROM o CROSS JOIN range(0, {ROUNDS}) r(r) LEFT JOIN c ON c.round = r.r AND c.xb = o.xb AND c.yb = o.yb)
    SELECT xb, yb, n, round(quantile_cont(m, 0.9), 6) AS th, n > quantile_cont(m, 0.9) AS above FROM g GROUP BY 1, 2, 3""",
)
def cooccurrence_significance(spark: SparkSession, sf: str) -> DataFrame:
    """Joint states that occur more often than after rotating the signals against each other."""
    df, tr = _binned(spark, sf)
    df = stage(df)
    seen = df.groupBy("xb", "yb").agg(F.count("*").alias("n"))
    chance = rotations.rotated_counts(df, tr, "xb", "yb", 0, ROUNDS).select("round", F.col("x").alias("xb"), F.col("y").alias("yb"), "n")
    out = replicates.above_chance(seen, chance, ["xb", "yb"], ROUNDS, 0.9)
    return out.select("xb", "yb", "n", rounded("th").alias("th"), "above")


@query(
    "transfer_entropy_2d",
    f"""WITH {BINNED}, tr AS (SELECT now.u, now.n - s.n AS lag1, now.n - t.n AS lag2, now.xb AS xn, now.yb AS yn, s.xb AS xs, s.yb AS ys, t.xb AS xt, t.yb AS yt
      FROM bn now JOIN bn s ON s.u = now.u AND now.n - s.n BETWEEN 1 AND 3 JOIN bn t ON t.u = now.u AND now.n - t.n BETWEEN 1 AND 3),
    k AS (SELECT lag1, lag2, 0::BIGINT AS dir, yn AS now, xs AS src, yt AS past, count(*) AS n FROM tr GROUP BY ALL
      UNION ALL SELECT lag1, lag2, 1::BIGINT, xn, ys, xt, count(*) FROM tr GROUP BY ALL),
    h AS (SELECT lag1, lag2, dir, n, n / sum(n) OVER g AS p, n / sum(n) OVER (PARTITION BY lag1, lag2, dir, src, past) AS given_both,
      sum(n) OVER (PARTITION BY lag1, lag2, dir, now, past) / sum(n) OVER (PARTITION BY lag1, lag2, dir, past) AS given_past
      FROM k WINDOW g AS (PARTITION BY lag1, lag2, dir))
    SELECT lag1, lag2, dir, round(sum(p * log2(given_both / given_past)), 8) AS te FROM h GROUP BY lag1, lag2, dir""",
)
def transfer_entropy_2d(spark: SparkSession, sf: str) -> DataFrame:
    """What the source lag1 ago tells about the target now beyond the target lag2 ago, for all pairs of lags."""
    df, tr = _binned(spark, sf)
    joint = lagged.lagged_contrast_2d(df, tr, "xb", "yb", 3)
    return lagged.transfer_entropy(joint, ["lag1", "lag2", "dir"]).withColumn("te", rounded("te", 8))


@query(
    "random_window_stats",
    f"""WITH {SER}, l AS (SELECT u, count(*) AS len FROM ser GROUP BY u HAVING count(*) >= 20),
    w AS (SELECT u, ('0x' || substr(md5(u || ':5'), 1, 8))::BIGINT % (len - 19) AS n0 FROM l)
    SELECT u, n0, count(*) AS n, round(avg(x), 9) AS m FROM ser JOIN w USING (u) WHERE ser.n >= n0 AND ser.n < n0 + 20 GROUP BY 1, 2""",
)
def random_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    """One random window of twenty samples per unit, placed by a hash."""
    ser, _ = series(spark, sf, "x")
    w = segments.random_windows(events(spark, sf).select("u"), ["u"], 20, seed=5)
    hit = ser.join(w, "u").filter("n >= n0 AND n < n0 + 20")
    return hit.groupBy("u", "n0").agg(F.count("*").alias("n"), rounded(F.avg("x"), 9).alias("m"))


@query(
    "silhouette_order",
    f"""WITH s AS ({SQL['silhouette']}) SELECT vec_id, label, row_number() OVER (ORDER BY label, s DESC, vec_id) - 1 AS pos,
    CASE WHEN row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1 THEN TRUE ELSE FALSE END AS boundary FROM s""",
)
def silhouette_order(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every point when sorted by cluster and falling silhouette, and where clusters begin."""
    from spiketide.plans.clusters import silhouette

    s = stage(silhouette(spark, sf).select("vec_id", "label", "s"))
    return clusters.silhouette_order(s, "label", "vec_id")


@query(
    "sample_targets",
    """WITH e AS (SELECT DISTINCT l_suppkey AS pre, l_partkey AS post FROM lineitem), r AS (SELECT pre, post, row_number() OVER (PARTITION BY pre
      ORDER BY ('0x' || substr(md5(pre || ':' || post || ':3'), 1, 8))::BIGINT, post) AS k FROM e)
    SELECT pre, post FROM r WHERE k <= 5""",
)
def sample_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five targets of every node, drawn without replacement by hash."""
    from spiketide.functions.columns import rank_hash
    from spiketide.plans.joins import supply_edges

    e = supply_edges(spark, sf).withColumn("seed", F.lit(3)).withColumn("h", rank_hash("pre", "post", "seed"))
    return segments.top_per_key(e, ["pre"], [F.col("h"), F.col("post")], 5).select("pre", "post")


@query(
    "square_image",
    "SELECT CAST(l_linenumber AS BIGINT) AS r, "
    + ", ".join(f"count(*) FILTER (round(l_discount * 100) = {c}) AS c{c}" for c in range(11))
    + " FROM lineitem GROUP BY 1",
)
def square_image(spark: SparkSession, sf: str) -> DataFrame:
    """A long grid as an image, one column per grid column."""
    src = table(spark, sf, "lineitem", "l_linenumber", "l_discount")
    g = src.select(F.col("l_linenumber").cast("bigint").alias("r"), F.round(F.col("l_discount") * 100).cast("int").alias("c"))
    wide = g.groupBy("r").pivot("c", list(range(11))).count()
    return wide.select("r", *[F.coalesce(F.col(str(c)), F.lit(0).cast("bigint")).alias(f"c{c}") for c in range(11)])


@query(
    "warmup_windows",
    f"""WITH {EV} SELECT kind, count(*) FILTER (d < 5) AS n_warm, count(*) FILTER (d >= 5) AS n, round(avg(x) FILTER (d >= 5), 9) AS m,
    count(*) FILTER (d >= 10 AND d < 20) AS n_monitor, round(avg(x) FILTER (d >= 10 AND d < 20), 9) AS m_monitor
    FROM (SELECT *, (t - 1704067200000000) // 86400000000 AS d FROM ev) GROUP BY kind""",
)
def warmup_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping summaries in one pass: everything after the warm-up, and a monitor window."""
    d = F.expr("(t - 1704067200000000) div 86400000000")
    ev = events(spark, sf).select("kind", "x", d.alias("d"))
    late, mon = F.col("d") >= 5, (F.col("d") >= 10) & (F.col("d") < 20)
    return ev.groupBy("kind").agg(
        F.count_if(~late).alias("n_warm"), F.count_if(late).alias("n"), rounded(F.avg(F.when(late, F.col("x"))), 9).alias("m"),
        F.count_if(mon).alias("n_monitor"), rounded(F.avg(F.when(mon, F.col("x"))), 9).alias("m_monitor"),
    )

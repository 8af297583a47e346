"""Queries: spectra, phases, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions import spectral
from spiketide.functions.columns import rounded
from spiketide.operators import inference, lagged, segments, signals
from spiketide.plans.rates import SER
from spiketide.plans.registry import query
from spiketide.plans.tables import series, table
from spiketide.session import stage

N = 64
FS = 64.0
DFT = """s AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS n FROM embeddings),
    y AS (SELECT vec_id, label, k.k, sum(v * cos(2 * pi() * k.k * n / 64)) AS re, -sum(v * sin(2 * pi() * k.k * n / 64)) AS im
      FROM s CROSS JOIN range(0, 32) k(k) GROUP BY ALL),
    a AS (SELECT vec_id, label, k, 2.0 / 64 * sqrt(re * re + im * im) AS amp FROM y)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding")


@query("dft_amplitude", f"WITH {DFT} SELECT vec_id, k, k::DOUBLE AS freq, round(k * 32.0 / 31, 6) AS freq_compat, round(amp, 7) AS amp FROM a")
def dft_amplitude(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.spectrum(vectors(spark, sf), ["vec_id"], "embedding")
    return out.select(
        "vec_id", "k", signals.frequency("k", N, FS).alias("freq"),
        rounded(signals.frequency("k", N, FS, compat=True)).alias("freq_compat"), rounded("amp", 7).alias("amp"),
    )


@query(
    "dominant_frequency",
    f"""WITH {DFT}, w AS (SELECT * FROM a WHERE k BETWEEN 2 AND 30),
    nb AS (SELECT *, lag(amp) OVER w AS l, lead(amp) OVER w AS r FROM w WINDOW w AS (PARTITION BY vec_id ORDER BY k))
    SELECT vec_id, arg_max(k, amp) AS k, round(max(amp), 7) AS amp FROM nb WHERE amp > l AND amp > r GROUP BY vec_id""",
)
def dominant_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Largest spectral peak between index 2 and 30."""
    spec = vectors(spark, sf).select("vec_id", spectral.amplitude("embedding").alias("a"))
    top = spec.select("vec_id", signals.dominant(F.col("a"), 2, 31).alias("p"))
    return top.select("vec_id", (-F.col("p.k")).cast("bigint").alias("k"), rounded("p.amp", 7).alias("amp")).filter("k IS NOT NULL")


@query(
    "stft",
    """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS n FROM embeddings),
    f AS (SELECT vec_id, f.f AS frame, n - f.f * 8 AS m, v * (0.5 - 0.5 * cos(2 * pi() * (n - f.f * 8) / 15)) AS v
      FROM s JOIN range(0, 6) f(f) ON n >= f.f * 8 AND n < f.f * 8 + 16),
    y AS (SELECT vec_id, frame, k.k, sum(v * cos(2 * pi() * k.k * m / 16)) AS re, sum(v * sin(2 * pi() * k.k * m / 16)) AS im
      FROM f CROSS JOIN range(0, 8) k(k) GROUP BY ALL)
    SELECT vec_id, frame, k, round(2.0 / 16 * sqrt(re * re + im * im), 7) AS amp FROM y""",
)
def stft(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 16 samples every 8."""
    return signals.stft(vectors(spark, sf), ["vec_id"], "embedding", 16, 8).withColumn("amp", rounded("amp", 7))


def _band_sql(name: str, k0: int, k1: int) -> str:
    return f"""{name} AS (SELECT vec_id, n.n, 2.0 / 64 * sum(re * cos(2 * pi() * k * n.n / 64) - im * sin(2 * pi() * k * n.n / 64)) AS zr,
      2.0 / 64 * sum(re * sin(2 * pi() * k * n.n / 64) + im * cos(2 * pi() * k * n.n / 64)) AS zi
      FROM y CROSS JOIN range(0, 64) n(n) WHERE k BETWEEN {k0} AND {k1} GROUP BY vec_id, n.n)"""


@query(
    "hilbert_phase",
    f"WITH {DFT}, {_band_sql('z', 4, 8)} SELECT vec_id, n, round(sqrt(zr * zr + zi * zi), 7) AS amp, round(atan2(zi, zr), 6) AS phase FROM z",
)
def hilbert_phase(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.band_phase(vectors(spark, sf), ["vec_id"], "embedding", 4, 8)
    return out.select("vec_id", "n", rounded("amp", 7).alias("amp"), rounded("phase").alias("phase"))


@query(
    "phase_at_amplitude_peaks",
    f"""WITH {DFT}, {_band_sql('zs', 1, 3)}, {_band_sql('zf', 8, 16)},
    j AS (SELECT vec_id, n, atan2(zs.zi, zs.zr) AS p, sqrt(zf.zr * zf.zr + zf.zi * zf.zi) AS a FROM zs JOIN zf USING (vec_id, n)),
    nb AS (SELECT *, lag(a) OVER w AS l, lead(a) OVER w AS r FROM j WINDOW w AS (PARTITION BY vec_id ORDER BY n))
    SELECT label, least(CAST(floor((p + pi()) / (2 * pi() / 12)) AS BIGINT), 11) AS b, count(*) AS n
    FROM nb JOIN (SELECT DISTINCT vec_id, label FROM s) USING (vec_id) WHERE a > l AND a > r GROUP BY 1, 2""",
)
def phase_at_amplitude_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Phase-amplitude coupling: slow phase at the peaks of the fast amplitude, twelve bins."""
    p = signals.phase_at_peaks(vectors(spark, sf), ["label"], "embedding", (1, 3), (8, 16))
    b = F.least(F.floor((F.col("phase") + F.pi()) / (F.pi() * 2 / 12)), F.lit(11).cast("bigint"))
    return p.groupBy("label", b.alias("b")).agg(F.count("*").alias("n"))


@query(
    "conditioned_spectrum",
    f"WITH {DFT} SELECT label, k, count(*) AS n, round(avg(amp), 7) AS m, round(var_pop(amp), 9) AS v FROM a GROUP BY label, k",
)
def conditioned_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and variance of the spectrum per condition."""
    spec = signals.spectrum(vectors(spark, sf), ["label"], "embedding")
    return spec.groupBy("label", "k").agg(
        F.count("*").alias("n"), rounded(F.avg("amp"), 7).alias("m"), rounded(F.var_pop("amp"), 9).alias("v")
    )


@query(
    "power_level_spectrum",
    f"""WITH {DFT}, p AS (SELECT vec_id, label, sum(amp * amp) FILTER (k BETWEEN 4 AND 8) AS p FROM a GROUP BY 1, 2),
    m AS (SELECT label, avg(p) AS m, stddev_pop(p) AS s FROM p GROUP BY label),
    l AS (SELECT vec_id, least(greatest(floor((p - m) / s), -2), 2)::BIGINT AS level FROM p JOIN m USING (label))
    SELECT level, k, count(*) AS n, round(avg(amp), 7) AS m FROM a JOIN l USING (vec_id) GROUP BY level, k""",
)
def power_level_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Mean spectrum per level of standardised band power."""
    spec = vectors(spark, sf).select("vec_id", "label", spectral.amplitude("embedding").alias("a"))
    band = F.aggregate(F.slice("a", 5, 5), F.lit(0.0), lambda s, v: s + v * v)
    lev = signals.z_levels(stage(spec.withColumn("p", band)), ["label"], "p", -2, 2)
    rows = lev.select("level", F.posexplode("a").alias("k", "amp"))
    return rows.groupBy("level", F.col("k").cast("bigint").alias("k")).agg(F.count("*").alias("n"), rounded(F.avg("amp"), 7).alias("m"))


@query(
    "spectral_threshold",
    f"""WITH {DFT}, m AS (SELECT label, k, avg(amp) AS m FROM a GROUP BY 1, 2),
    b AS (SELECT label, max(m) FILTER (k = 4) AS b4, max(m) FILTER (k = 8) AS b8, max(m) FILTER (k = 14) AS b14, max(m) FILTER (k = 20) AS b20 FROM m GROUP BY 1),
    t AS (SELECT label, k, CASE WHEN k < 4 THEN b4 * 1.2 WHEN k > 20 THEN b20 * 1.2
      WHEN k > 8 AND k < 14 THEN (b8 + (b14 - b8) * (k - 8) / 6.0) * 1.2 ELSE m END AS th FROM m JOIN b USING (label))
    SELECT label, k, round(any_value(th), 7) AS th, count(*) FILTER (amp > th) AS above FROM a JOIN t USING (label, k) GROUP BY label, k""",
)
def spectral_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Detection threshold per frequency and how many samples exceed it."""
    spec = signals.spectrum(vectors(spark, sf), ["label"], "embedding")
    avg = spec.groupBy("label", "k").agg(F.avg("amp").alias("m"))
    th = stage(signals.rest_threshold(avg, ["label"], "k", "m", [(4, 8), (14, 20)]).select("label", "k", "th"))
    return spec.join(th, ["label", "k"]).groupBy("label", "k").agg(
        rounded(F.max("th"), 7).alias("th"), F.count_if(F.col("amp") > F.col("th")).alias("above")
    )


@query(
    "frequency_row_mask",
    f"""WITH {DFT}, q AS (SELECT k, quantile_cont(amp, 0.95) AS q FROM a GROUP BY k)
    SELECT k, round(any_value(q), 7) AS q, count(*) FILTER (amp > q) AS above FROM a JOIN q USING (k) GROUP BY k""",
)
def frequency_row_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Own 95 percent threshold per frequency row."""
    spec = stage(signals.spectrum(vectors(spark, sf), ["label"], "embedding"))
    q = stage(inference.exact_quantiles(spec, ["k"], "amp", [0.95]).select("k", "q"))
    return spec.join(q, "k").groupBy("k").agg(rounded(F.max("q"), 7).alias("q"), F.count_if(F.col("amp") > F.col("q")).alias("above"))


@query("lorentz_fit")
def lorentz_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Peak fitted to the mean spectrum of each label (32 points per label)."""
    mean = signals.spectrum(vectors(spark, sf), ["label"], "embedding").groupBy("label", "k").agg(F.avg("amp").alias("m"))
    curve = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c"))
    freq = F.transform("c", lambda p: p["k"].cast("double"))
    return curve.select("label", spectral.lorentz_fit(freq, F.col("c.m")).alias("f")).select("label", "f.*")


GRID = """g AS (SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, avg(l_extendedprice) AS z
      FROM lineitem GROUP BY 1, 2)"""


def price_grid(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem", "l_linenumber", "l_discount", "l_extendedprice")
        .groupBy(F.col("l_linenumber").cast("bigint").alias("i"), F.round(F.col("l_discount") * 100).cast("bigint").alias("j"))
        .agg(F.avg("l_extendedprice").alias("z"))
    )


@query(
    "bilinear_sample",
    f"""WITH {GRID}, p AS (SELECT s.s, 1 + s.s * (5.9 / 20) AS x, 0.3 + s.s * (9.4 / 20) AS y FROM range(0, 21) s(s)),
    c AS (SELECT s, floor(x)::BIGINT + a.a AS i, floor(y)::BIGINT + b.b AS j,
      (CASE WHEN a.a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b.b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
      FROM p CROSS JOIN range(0, 2) a(a) CROSS JOIN range(0, 2) b(b))
    SELECT s, round(sum(w * z), 4) AS z FROM c JOIN g USING (i, j) WHERE w > 0 GROUP BY s""",
)
def bilinear_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Surface sampled along a line of 21 points."""
    grid = price_grid(spark, sf)
    s = F.col("id")
    pts = spark.range(21).select(s.alias("s"), (1 + s * (5.9 / 20)).alias("i"), (0.3 + s * (9.4 / 20)).alias("j"))
    return signals.weighted_lookup(pts, grid, ["i", "j"], "z", ["s"]).withColumn("z", rounded("z", 4))


@query(
    "autocorr_peaks",
    f"""WITH {SER}, d AS (SELECT u, n, x - avg(x) OVER (PARTITION BY u) AS x FROM ser),
    c AS (SELECT a.u, b.n - a.n AS lag, avg(a.x * b.x) AS c FROM d a JOIN d b ON a.u = b.u AND b.n - a.n BETWEEN 0 AND 10 GROUP BY 1, 2),
    nb AS (SELECT *, lag(c) OVER w AS l, lead(c) OVER w AS r FROM c WINDOW w AS (PARTITION BY u ORDER BY lag))
    SELECT u, min(lag) AS first_lag, arg_max(lag, c) AS large_lag, round(max(c), 5) AS large FROM nb WHERE c > l AND c > r GROUP BY u""",
)
def autocorr_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """First and largest side peak of the autocorrelation."""
    ser, tr = series(spark, sf, "x")
    ac = lagged.correlation(ser, tr, "x", "x", range(0, 11), scale=False)
    w = segments.W.partitionBy("u").orderBy("lag")  # eleven lags per unit
    near = ac.select("*", F.lag("c").over(w).alias("l"), F.lead("c").over(w).alias("r")).filter("c > l AND c > r")
    return near.groupBy("u").agg(
        F.min("lag").alias("first_lag"), F.max_by("lag", "c").alias("large_lag"), rounded(F.max("c"), 5).alias("large")
    )

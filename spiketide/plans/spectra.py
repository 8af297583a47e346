"""Queries: spectra of signals stored as rows, and state words from band power."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import inference, segments, spectra
from spiketide.operators.ordered import neighbours
from spiketide.plans.rates import SER
from spiketide.plans.registry import query
from spiketide.plans.segments import _absorb_sql, rle_sql
from spiketide.plans.tables import series
from spiketide.session import stage

WIDTH, HOP, PADDED = 16, 4, 32
PRIME = 2_147_483_647


def _dft_sql(size: str) -> str:
    return f"""SELECT u, {size} AS size, k.k, sum(x * cos(2 * pi() * ((k.k * n) % {size}) / {size})) AS re, sum(x * sin(2 * pi() * ((k.k * n) % {size}) / {size})) AS im
      FROM ser JOIN (SELECT u, count(*) AS len FROM ser GROUP BY u) USING (u) CROSS JOIN range(1, 12) k(k) WHERE n < {size} AND k.k < {size} // 2 GROUP BY ALL"""


@query(
    "row_spectrum",
    f"WITH {SER}, y AS ({_dft_sql('len')}) SELECT u, size, k, round(k * 1000.0 / size, 6) AS freq, round(2.0 / size * sqrt(re * re + im * im), 6) AS amp FROM y",
)
def row_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Spectrum of every whole signal at its own length, sampled at 1000 Hz."""
    out = spectra.row_spectrum(*series(spark, sf, "x"), "x", 1, 12)
    return out.select("u", "size", "k", rounded(F.col("k") * 1000.0 / F.col("size")).alias("freq"), rounded("amp").alias("amp"))


@query(
    "row_spectrum_padded",
    f"WITH {SER}, y AS ({_dft_sql('128')}) SELECT u, k, round(k * 500.0 / 63, 6) AS freq, round(2.0 / size * sqrt(re * re + im * im), 6) AS amp FROM y",
)
def row_spectrum_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Spectrum of every signal padded or cut to 128 samples, on the stretched frequency axis."""
    out = spectra.row_spectrum(*series(spark, sf, "x"), "x", 1, 12, nbin=128)
    return out.select("u", "k", rounded(F.col("k") * 500.0 / 63).alias("freq"), rounded("amp").alias("amp"))


def frames_sql(name: str, value: str, hop: int, size: int) -> str:
    return f"""{name}_c AS (SELECT u, f.f AS frame, n - f.f * {hop} AS m, {value} * (0.5 - 0.5 * cos(2 * pi() * (n - f.f * {hop}) / {WIDTH - 1})) AS v
      FROM ser JOIN (SELECT u, count(*) AS len FROM ser GROUP BY u) USING (u) JOIN range(0, 1000000) f(f) ON f.f * {hop} <= n AND f.f * {hop} + {WIDTH} > n AND f.f * {hop} + {WIDTH} < len),
    {name}_y AS (SELECT u, frame, k.k, sum(v * cos(2 * pi() * k.k * m / {size})) AS re, sum(v * sin(2 * pi() * k.k * m / {size})) AS im
      FROM {name}_c CROSS JOIN range(0, {size // 2}) k(k) GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT u, frame, k, 2.0 / {size} * sqrt(re * re + im * im) AS amp FROM {name}_y)"""


@query("frame_spectrum", f"WITH {SER}, {frames_sql('fr', 'x', HOP, PADDED)} SELECT u, frame, k, round(amp, 6) AS amp FROM fr")
def frame_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Hann-weighted frames of 16 samples every 4, padded to 32."""
    ser, tr = series(spark, sf, "x")
    out = spectra.bins(spectra.frame_spectrum(ser, tr, "x", WIDTH, HOP, PADDED), ["u", "frame"])
    return out.withColumn("amp", rounded("amp"))


@query(
    "frame_mean_spectrum",
    f"WITH {SER}, {frames_sql('fr', 'x', HOP, PADDED)} SELECT u, k, count(*) AS n, round(avg(amp), 6) AS amp FROM fr GROUP BY u, k",
)
def frame_mean_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Spectrum of each signal averaged over its frames."""
    ser, tr = series(spark, sf, "x")
    out = spectra.mean_spectrum(spectra.frame_spectrum(ser, tr, "x", WIDTH, HOP, PADDED), ["u"])
    return out.withColumn("amp", rounded("amp"))


@query(
    "window_peak_frequency",
    f"""WITH {SER}, a AS (SELECT u, len, i.i AS i, (u * 48271 + i.i * 40692 + 1) % {PRIME} AS h FROM (SELECT u, count(*) AS len FROM ser GROUP BY u) CROSS JOIN range(0, 10) i(i) WHERE len >= {WIDTH}),
    st AS (SELECT u, i, (h * h % {PRIME} + h * 16807 + 7) % (len - {WIDTH - 1}) AS s FROM a),
    y AS (SELECT u, i, k.k, sum(x * cos(2 * pi() * k.k * (n - s) / {WIDTH})) AS re, sum(x * sin(2 * pi() * k.k * (n - s) / {WIDTH})) AS im
      FROM ser JOIN st USING (u) CROSS JOIN range(1, {WIDTH // 2}) k(k) WHERE n >= s AND n < s + {WIDTH} GROUP BY ALL),
    m AS (SELECT u, k, avg(2.0 / {WIDTH} * sqrt(re * re + im * im)) AS amp FROM y GROUP BY u, k)
    SELECT u, arg_max(k, amp) AS k, round(max(amp), 6) AS amp FROM m GROUP BY u""",
)
def window_peak_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Peak of the spectrum averaged over ten drawn windows of each signal."""
    ser, tr = series(spark, sf, "x")
    size = ser.groupBy("u").agg(F.count("*").alias("len")).filter(F.col("len") >= WIDTH)
    asked = size.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    h = (F.col("u") * 48_271 + F.col("window") * 40_692 + 1) % PRIME
    start = (h * h % PRIME + h * 16_807 + 7) % (F.col("len") - (WIDTH - 1))
    spec = spectra.window_spectrum(ser, tr, "x", asked.select("u", "window", start.alias("start")), WIDTH)
    top = spectra.peak_frequency(spectra.mean_spectrum(spec, ["u"]), ["u"], 1, WIDTH // 2 - 1)
    return top.select("u", "k", rounded("amp").alias("amp"))


# two signals (value, minutes since the event before) and two bands of frequency indices each: the tracks of a word
WORD_HOP = 2
BANDS = {"x_slow": ("x", 1, 2), "x_fast": ("x", 4, 6), "gap_slow": ("g", 1, 2), "gap_fast": ("g", 4, 6)}
MOST_QUIET = 0.6  # a band is on above this quantile of its power


def bridge(lo: int, hi: int) -> int:
    """Frames that two cycles of a band's middle frequency last."""
    return int(2 / ((lo + hi) / 2 / WIDTH) / WORD_HOP)


def _words_sql() -> str:
    power = ", ".join(
        f"sum(f{s}.amp) FILTER (f{s}.k BETWEEN {lo} AND {hi}) / {hi - lo + 1} AS {name}" for name, (s, lo, hi) in BANDS.items()
    )
    limits = ", ".join(f"quantile_cont({b}, {MOST_QUIET}) AS {b}" for b in BANDS)
    on = ", ".join(f"pw.{b} > lim.{b} AS {b}" for b in BANDS)
    fills = ", ".join(
        f"""{b} OR coalesce(min(CASE WHEN {b} THEN n END) OVER (PARTITION BY u ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
        - coalesce(max(CASE WHEN {b} THEN n END) OVER (PARTITION BY u ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 <= {bridge(lo, hi)}, false) AS {b}"""
        for b, (_, lo, hi) in BANDS.items()
    )
    word = " + ".join(f"CASE WHEN {b} THEN {1 << i} ELSE 0 END" for i, b in enumerate(BANDS))
    ser = SER.replace("SELECT *, row_number()", "SELECT *, coalesce((t - lag(t) OVER (PARTITION BY u ORDER BY event_id)) / 60e6, 0) AS g, row_number()")
    return f"""WITH {ser}, {frames_sql('fx', 'x', WORD_HOP, WIDTH)}, {frames_sql('fg', 'g', WORD_HOP, WIDTH)},
    pw AS MATERIALIZED (SELECT u, frame AS n, {power} FROM fx JOIN fg USING (u, frame, k) GROUP BY u, frame),
    lim AS (SELECT {limits} FROM pw),
    bits AS (SELECT u, n, {on} FROM pw CROSS JOIN lim),
    filled AS (SELECT u, n, {fills} FROM bits),
    wrd AS (SELECT u, n, CAST({word} AS BIGINT) AS word FROM filled), {rle_sql('wr', 'wrd', 'word')}, {_absorb_sql('ab', 'wr', 3)}"""


WORDS = _words_sql()


def band_words(spark: SparkSession, sf: str) -> tuple[DataFrame, spectra.Track]:
    """State word of every frame: which bands of both signals are on, with gaps of two cycles closed."""
    ser, tr = series(spark, sf, "event_id", "t", "x")
    gap = F.coalesce((F.col("t") - F.col("prev_t")) / 60e6, F.lit(0.0))
    both = stage(neighbours(ser, tr, prev=["t"]).select("u", "n", "x", gap.alias("g")))
    frames = {s: spectra.frame_spectrum(both, tr, s, WIDTH, WORD_HOP) for s in ("x", "g")}
    power = [
        frames[s].select("u", F.col("frame").alias("n"), *[spectra.band("amps", lo, hi).alias(b) for b, (of, lo, hi) in BANDS.items() if of == s]) for s in frames
    ]
    power = stage(power[0].join(power[1], ["u", "n"]))
    long = power.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("p")) for b in BANDS])))
    limits = inference.exact_quantiles(long, ["band"], "p", [MOST_QUIET])
    wide = stage(limits.groupBy().agg(*[F.max(F.when(F.col("band") == b, F.col("q"))).alias(f"lim_{b}") for b in BANDS]))
    bits = power.crossJoin(wide).select("u", "n", *[(F.col(b) > F.col(f"lim_{b}")).alias(b) for b in BANDS])  # one row of limits
    at = tr.at("n", width=max(tr.width, max(bridge(lo, hi) for _, lo, hi in BANDS.values())))
    filled = reduce(lambda df, b: segments.fill_gaps(df, at, [b], bridge(*BANDS[b][1:])), BANDS, bits)
    return filled.select("u", "n", segments.state_word([F.col(b) for b in BANDS]).alias("word")), at


@query("band_power_words", f"{WORDS} SELECT word, count(*) AS n FROM wrd GROUP BY word")
def band_power_words(spark: SparkSession, sf: str) -> DataFrame:
    """How many frames have each combination of bands on."""
    return band_words(spark, sf)[0].groupBy("word").agg(F.count("*").alias("n"))


@query("band_motifs", f'{WORDS} SELECT u, "start", "end", state FROM ab WHERE state <> 0 OR "end" - "start" >= 3')
def band_motifs(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of equal words, short ones absorbed by a neighbour that contains them."""
    words, at = band_words(spark, sf)
    return segments.drop_short_rest(segments.absorb_short(segments.runs(words, at, "word"), at, 3), 3)

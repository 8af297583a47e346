"""Queries: segmentation of ordered signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import gaussian_taps, rounded
from spiketide.operators import segments
from spiketide.plans.rates import EV, POP, SER, pop_of
from spiketide.plans.registry import query
from spiketide.plans.tables import BASE_SQL, DAYS_SQL, HOUR, T0, days, event_track, events, first_day, series, table
from spiketide.session import stage


def rle_sql(out: str, src: str, state: str) -> str:
    return f"""{out}_i AS (SELECT u, n, {state} AS state, n - row_number() OVER (PARTITION BY u, {state} ORDER BY n) AS g FROM {src}),
    {out} AS (SELECT u, min(n) AS "start", max(n) + 1 AS "end", CAST(state AS BIGINT) AS state FROM {out}_i GROUP BY u, state, g)"""


HIGH = "CAST(x > 34.59 AS BIGINT)"
RLE = f"WITH {SER}, {rle_sql('r', 'ser', HIGH)}"


def high_state(spark: SparkSession, sf: str):
    ser, tr = series(spark, sf, "x")
    return ser.select("u", "n", (F.col("x") > 34.59).cast("bigint").alias("state")), tr


@query("rle_states", f'{RLE} SELECT u, "start", "end", state FROM r')
def rle_states(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = high_state(spark, sf)
    return segments.runs(df, tr, "state")


@query("min_duration_filter", f'{RLE} SELECT u, "start", "end", state FROM r WHERE state <> 0 OR "end" - "start" >= 3')
def min_duration_filter(spark: SparkSession, sf: str) -> DataFrame:
    return segments.drop_short_rest(rle_states(spark, sf), 3)


@query("bool_runs", f'{RLE} SELECT u, "start", "end" - "start" AS len FROM r WHERE state = 1')
def bool_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Connected runs of a boolean signal."""
    r = rle_states(spark, sf).filter("state = 1")
    return r.select("u", "start", (F.col("end") - F.col("start")).alias("len"))


@query(
    "gap_fill",
    f"""WITH {SER}, f AS (SELECT u, n, x > 34.59 AS f FROM ser),
    g AS (SELECT u, n, f, coalesce(max(CASE WHEN f THEN n END) OVER (PARTITION BY u ORDER BY n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p, min(CASE WHEN f THEN n END) OVER (PARTITION BY u
      ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM f)
    SELECT u, n, f AS raw, coalesce(f OR q - p - 1 <= 2, FALSE) AS filled FROM g""",
)
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    ser, tr = series(spark, sf, "x")
    flag = F.col("x") > 34.59
    df = ser.select("u", "n", flag.alias("raw"), flag.alias("filled"))
    return segments.fill_gaps(df, tr, ["filled"], 2)


# Four boolean tracks, the word they form, and the motif chain built on it.
TRACKS = {"b0": "x > 20", "b1": "x > 60", "b2": "kind IN ('view', 'click', 'error')", "b3": "kind = 'click' OR x > 100"}


def _fill_sql() -> str:
    per = []
    for b in TRACKS:
        per.append(
            f"""{b} OR coalesce(min(CASE WHEN {b} THEN n END) OVER (PARTITION BY u ORDER BY n
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - coalesce(max(CASE WHEN {b} THEN n END) OVER (PARTITION BY u
            ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 <= 1, FALSE) AS {b}"""
        )
    raw = ", ".join(f"({e}) AS {b}" for b, e in TRACKS.items())
    word = " + ".join(f"CASE WHEN {b} THEN {1 << i} ELSE 0 END" for i, b in enumerate(TRACKS))
    return f"""trk AS (SELECT u, n, {raw} FROM ser), fld AS (SELECT u, n, {', '.join(per)} FROM trk),
    wrd AS (SELECT u, n, CAST({word} AS BIGINT) AS word FROM fld)"""


def _absorb_sql(out: str, src: str, m: int) -> str:
    return f"""{out}_a AS (SELECT *, state <> 0 AND "end" - "start" < {m} AS sh,
      lag(state) OVER w AS ps, lead(state) OVER w AS ns FROM {src} WINDOW w AS (PARTITION BY u ORDER BY "start")),
    {out}_b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY "start")
      - row_number() OVER (PARTITION BY u, sh ORDER BY "start") AS g FROM {out}_a),
    {out}_c AS (SELECT u, g, min("start") AS s, max("end") AS e, bit_or(state) AS own,
      arg_min(ps, "start") AS ps, arg_max(ns, "start") AS ns,
      count(*) AS k FROM {out}_b WHERE sh GROUP BY u, g),
    {out}_n AS (SELECT u, "start" AS s, "end" AS e, state FROM {out}_b WHERE NOT sh UNION ALL
      SELECT u, s, e, CASE WHEN ns <> 0 AND (ns | own) = ns THEN ns
      WHEN ps <> 0 AND (ps | own) = ps THEN ps ELSE own END FROM {out}_c),
    {out}_d AS (SELECT *, CASE WHEN lag(state) OVER w = state AND lag(e) OVER w = s THEN 0 ELSE 1 END AS new
      FROM {out}_n WINDOW w AS (PARTITION BY u ORDER BY s)),
    {out}_e AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY s) AS id FROM {out}_d),
    {out} AS (SELECT u, min(s) AS "start", max(e) AS "end", any_value(state) AS state FROM {out}_e GROUP BY u, id)"""


CHAIN = f"WITH {SER}, {_fill_sql()}, {rle_sql('wr', 'wrd', 'word')}, {_absorb_sql('ab', 'wr', 3)}"


def words(spark: SparkSession, sf: str):
    """State word per sample: four tracks, each with gaps of one sample closed."""
    ser, tr = series(spark, sf, "x", "kind")
    raw = ser.select("u", "n", *[F.expr(e).alias(b) for b, e in TRACKS.items()])
    full = segments.fill_gaps(raw, tr, list(TRACKS), 1)
    return full.select("u", "n", segments.state_word([F.col(b) for b in TRACKS]).alias("word")), tr


def motifs(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = words(spark, sf)
    return segments.drop_short_rest(segments.absorb_short(segments.runs(df, tr, "word"), tr, 3), 3)


@query("state_words", f"{CHAIN} SELECT word, count(*) AS n FROM wrd GROUP BY word")
def state_words(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf)[0].groupBy("word").agg(F.count("*").alias("n"))


@query("absorb_short", f'{CHAIN} SELECT u, "start", "end", state FROM ab')
def absorb_short(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = words(spark, sf)
    return segments.absorb_short(segments.runs(df, tr, "word"), tr, 3)


@query("motif_intervals", f'{CHAIN} SELECT u, "start", "end", state FROM ab WHERE state <> 0 OR "end" - "start" >= 3')
def motif_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return motifs(spark, sf)


@query(
    "motif_proportion",
    f"""{CHAIN}, c AS (SELECT {POP} AS pop, state, count(*) AS n FROM ab WHERE state <> 0 GROUP BY 1, 2)
    SELECT pop, state, n, round(n / sum(n) OVER (PARTITION BY pop), 9) AS share,
    round(n / ({DAYS_SQL} * 86400.0 * count(*) OVER ()), 12) AS rate FROM c""",
)
def motif_proportion(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each non-zero motif within its population, and motifs per second and state."""
    n = motifs(spark, sf).filter("state <> 0").groupBy(pop_of().alias("pop"), "state").agg(F.count("*").alias("n"))
    states = F.count("*").over(segments.W.partitionBy(F.lit(1)))  # at most 2 x 15 rows
    out = n.select("*", F.sum("n").over(segments.W.partitionBy("pop")).alias("tot"), states.alias("k"))
    return out.select(
        "pop", "state", "n",
        rounded(F.col("n") / F.col("tot"), 9).alias("share"),
        rounded(F.col("n") / (F.col("k") * (days(spark, sf) * 86400.0)), 12).alias("rate"),
    )


@query(
    "interval_stab",
    f"""{RLE} SELECT {POP} AS pop, r.state, count(*) AS n, round(avg(x), 9) AS m, round(var_pop(x), 6) AS v
    FROM ser JOIN r USING (u) WHERE ser.n >= r."start" AND ser.n < r."end" GROUP BY 1, 2""",
)
def interval_stab(spark: SparkSession, sf: str) -> DataFrame:
    """Signal moments conditioned on the interval that holds each sample."""
    ser, tr = series(spark, sf, "x")
    ser = stage(ser)
    iv = segments.runs(ser.select("u", "n", (F.col("x") > 34.59).cast("bigint").alias("state")), tr, "state")
    hit = segments.stab(ser.select("u", "n", "x"), stage(iv), tr)
    return (
        hit.filter("state IS NOT NULL")
        .groupBy(pop_of().alias("pop"), "state")
        .agg(F.count("*").alias("n"), rounded(F.avg("x"), 9).alias("m"), rounded(F.var_pop("x")).alias("v"))
    )


PEAKS = f"""WITH {SER}, nb AS (SELECT u, n, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM ser
    WINDOW w AS (PARTITION BY u ORDER BY n)), pk AS (SELECT u, n, x FROM nb WHERE x > a AND x > b)"""


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    ser, tr = series(spark, sf, "x")
    return segments.local_peaks(ser.select("u", "n", "x"), tr, "x")


@query("local_peaks", f"{PEAKS} SELECT u, n, x FROM pk")
def local_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return peaks(spark, sf)


@query(
    "peaks_nearest",
    f"""{PEAKS}, mid AS (SELECT u, count(*) // 2 AS mid FROM ser GROUP BY u),
    rk AS (SELECT u, n, x, row_number() OVER (PARTITION BY u ORDER BY abs(n - mid), n) AS rank FROM pk JOIN mid USING (u))
    SELECT u, n, x, rank FROM rk WHERE rank <= 3""",
)
def peaks_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The three peaks closest to the middle of each series."""
    mid = events(spark, sf).groupBy("u").agg(F.expr("count(*) div 2").alias("mid"))
    near = peaks(spark, sf).join(mid, "u")
    out = segments.top_per_key(near, ["u"], [F.abs(F.col("n") - F.col("mid")), F.col("n")], 3)
    return out.select("u", "n", "x", F.col("rank").cast("bigint").alias("rank"))


@query(
    "two_largest_peaks",
    f"""{PEAKS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY x DESC, n) AS k FROM pk) WHERE k = 1),
    s AS (SELECT * FROM (SELECT pk.*, row_number() OVER (PARTITION BY pk.u ORDER BY pk.x DESC, pk.n) AS k FROM pk
          JOIN f ON f.u = pk.u AND abs(f.n - pk.n) >= 5) WHERE k = 1)
    SELECT f.u, f.n AS n0, f.x AS v0, CASE WHEN s.x >= f.x * (1.0 / 3) THEN s.n ELSE f.n END AS n1
    FROM f LEFT JOIN s ON s.u = f.u""",
)
def two_largest_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return segments.two_peaks(stage(peaks(spark, sf)), ["u"], "n", "x")


@query(
    "upward_crossings",
    f"""WITH {SER}, p AS (SELECT u, n, x, lag(x) OVER (PARTITION BY u ORDER BY n) AS a FROM ser)
    SELECT u, n, x FROM p WHERE a < 34.59 AND x > 34.59""",
)
def upward_crossings(spark: SparkSession, sf: str) -> DataFrame:
    ser, tr = series(spark, sf, "x")
    return segments.upward_crossings(ser.select("u", "n", "x"), tr, "x", 34.59)


@query("downsample_stride", f"WITH {SER} SELECT u, n // 5 AS n, x FROM ser WHERE n % 5 = 0")
def downsample_stride(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth sample, renumbered; no anti-alias filter."""
    ser, _ = series(spark, sf, "x")
    return ser.filter("n % 5 = 0").select("u", F.expr("n div 5").alias("n"), "x")


TAPS = gaussian_taps(1.0, 3)
TAP_ROWS = ", ".join(f"({j}, {w!r}::DOUBLE)" for j, w in zip(range(-3, 4), TAPS))


@query(
    "gaussian_smooth",
    f"""WITH {SER}, k(j, w) AS (VALUES {TAP_ROWS})
    SELECT a.u, a.n, round(sum(b.x * k.w), 6) AS smooth FROM ser a CROSS JOIN k JOIN ser b ON b.u = a.u AND b.n = a.n + k.j
    GROUP BY a.u, a.n HAVING count(*) = 7""",
)
def gaussian_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Seven-tap Gaussian, inner samples only."""
    ser, tr = series(spark, sf, "x")
    out = segments.smooth(ser, tr, "x", TAPS)
    return out.select("u", "n", rounded("smooth").alias("smooth"))


@query(
    "mua_smooth",
    f"""WITH {EV}, k(j, w) AS (VALUES {TAP_ROWS}),
    g AS (SELECT p.pop, h.h FROM (SELECT DISTINCT {POP} AS pop FROM ev) p CROSS JOIN (SELECT unnest(range(0, {DAYS_SQL} * 24)) AS h) h),
    c AS (SELECT {POP} AS pop, (t - {BASE_SQL}) // {HOUR} AS h, count(*) AS c FROM ev GROUP BY 1, 2),
    m AS (SELECT g.pop, g.h, coalesce(c.c, 0)::DOUBLE AS c FROM g LEFT JOIN c USING (pop, h)),
    n AS (SELECT {DAYS_SQL} * 24 AS n),
    i AS (SELECT pop, h, w, CASE WHEN h + j < 0 THEN -1 - (h + j) WHEN h + j >= n THEN 2 * n - 1 - (h + j) ELSE h + j END AS s
          FROM m CROSS JOIN k CROSS JOIN n)
    SELECT i.pop, i.h, round(sum(m.c * w), 6) AS mua FROM i JOIN m ON m.pop = i.pop AND m.h = i.s GROUP BY i.pop, i.h""",
)
def mua_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-unit activity: event counts per hour and population, smoothed with mirrored ends."""
    from spiketide.functions.columns import floor_div
    from spiketide.operators.ordered import Track

    tr = Track(("pop",), "h", 720, flat=True)
    h = floor_div(F.col("t") - first_day(spark, sf), HOUR)
    counts = events(spark, sf).groupBy(pop_of().alias("pop"), h.alias("h")).agg(F.count("*").cast("double").alias("c"))
    length = counts.select("pop").distinct().withColumn("length", days(spark, sf) * 24)
    blank = length.select("pop", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("h"), F.lit(0.0).alias("c"))
    full = counts.unionByName(blank).groupBy("pop", "h").agg(F.sum("c").alias("c"))
    out = segments.smooth(full, tr, "c", TAPS, length)
    return out.select("pop", "h", rounded("smooth").alias("mua"))


@query(
    "second_difference",
    """WITH m AS (SELECT o_orderpriority AS prio, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m,
      sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    d AS (SELECT prio, m, (lag(v) OVER w + lead(v) OVER w - 2 * v) / 2 AS d FROM m WINDOW w AS (PARTITION BY prio ORDER BY m))
    SELECT prio, m, round(d, 3) AS d2 FROM d WHERE d IS NOT NULL""",
)
def second_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Elbow of a curve; the curve has one point per calendar month."""
    d = F.col("o_orderdate")
    m = (
        table(spark, sf, "orders", "o_orderpriority", "o_orderdate", "o_totalprice")
        .groupBy(F.col("o_orderpriority").alias("prio"), (F.year(d) * 12 + F.month(d)).cast("bigint").alias("m"))
        .agg(F.sum("o_totalprice").alias("v"))
    )
    w = segments.W.partitionBy("prio").orderBy("m")
    v = F.col("v")
    d2 = (F.lag(v).over(w) + F.lead(v).over(w) - 2 * v) / 2
    return m.select("prio", "m", rounded(d2, 3).alias("d2")).filter("d2 IS NOT NULL")


@query(
    "sliding_summary",
    f"""WITH {EV}, s AS (SELECT {BASE_SQL} - 43200000000 + i * 43200000000 AS s FROM (SELECT unnest(range(0, 2 * {DAYS_SQL} + 1)) AS i))
    SELECT s.s AS start_us, count(*) AS n, round(avg(x), 9) AS m, round(stddev_pop(x), 9) AS sd
    FROM s JOIN ev ON ev.t >= s.s AND ev.t < s.s + 86400000000 GROUP BY s.s""",
)
def sliding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows of one day every half day."""
    from spiketide.streaming.windows import sliding

    ev = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))
    out = sliding(ev, "1 day", "12 hours")
    return out.select("start_us", "n", rounded("m", 9).alias("m"), rounded("sd", 9).alias("sd"))


@query(
    "session_bursts",
    f"""WITH {EV}, f AS (SELECT u, t, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY event_id) <= {6 * HOUR} THEN 0 ELSE 1 END AS new,
      event_id FROM ev), g AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY event_id) AS id FROM f)
    SELECT u, min(t) AS start_us, max(t) AS end_us, count(*) AS events FROM g GROUP BY u, id""",
)
def session_bursts(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.sessions(events(spark, sf), event_track(spark, sf), "t", 6 * HOUR)
    return out.select("u", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "events")

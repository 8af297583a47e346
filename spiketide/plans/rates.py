"""Queries: rates, interval statistics, synchrony, grouped moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import angle_spread_compat, circular_dispersion, circular_mean, floor_div, in_band, period_ms, rounded
from spiketide.operators import rates
from spiketide.plans.registry import query
from spiketide.plans.tables import BASE_SQL, DAY, DAYS_SQL, HOUR, T0, days, event_track, events, table

EV = "ev AS (SELECT user_id AS u, event_id, epoch_us(ts) AS t, event_type AS kind, value AS x FROM events)"
SER = EV + ", ser AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY event_id) - 1 AS n FROM ev)"
POP = "CASE WHEN u % 2 = 0 THEN 'F' ELSE 'S' END"


def pop_of(u: str = "u"):
    return F.when(F.pmod(F.col(u), F.lit(2)) == 0, "F").otherwise("S")


def in_pops(df: DataFrame) -> DataFrame:
    """Every unit counts once for its population and once for the total."""
    return df.withColumn("pop", F.explode(F.array(F.lit("total"), pop_of())))


@query(
    "firing_rate",
    f"""WITH {EV}, us AS (SELECT DISTINCT u FROM ev), ks AS (SELECT DISTINCT kind FROM ev),
    c AS (SELECT kind, u, count(*) AS c FROM ev GROUP BY kind, u),
    f AS (SELECT ks.kind, coalesce(c.c, 0) / ({DAYS_SQL} * 24.0) AS r FROM us CROSS JOIN ks
          LEFT JOIN c ON c.u = us.u AND c.kind = ks.kind)
    SELECT kind, round(avg(r), 9) AS frs_m, round(stddev_pop(r), 9) AS frs_s FROM f GROUP BY kind""",
)
def firing_rate(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("kind", "u")
    counts = ev.groupBy("kind", "u").agg(F.count("*").alias("c"))
    units = ev.agg(F.countDistinct("u")).scalar()
    out = rates.firing_rate(counts.withColumn("units", units), "kind", F.max("units"), days(spark, sf) * 24)
    return out.select("kind", rounded("frs_m", 9).alias("frs_m"), rounded("frs_s", 9).alias("frs_s"))


CV_SQL = f"""d AS (SELECT u, t - lag(t) OVER (PARTITION BY u ORDER BY event_id) AS d FROM ev),
    cv AS (SELECT u, CASE WHEN count(*) >= 3 THEN stddev_pop(d) / nullif(avg(d), 0) END AS cv,
           count(*) AS events FROM d GROUP BY u)"""


@query(
    "cv_isi",
    f"""WITH {EV}, {CV_SQL}
    SELECT {POP} AS pop, count(cv) AS units, round(avg(cv), 6) AS cv FROM cv GROUP BY 1""",
)
def cv_isi(spark: SparkSession, sf: str) -> DataFrame:
    per_unit = rates.interval_cv(events(spark, sf).select("u", "event_id", "t"), event_track(spark, sf), "t")
    return per_unit.groupBy(pop_of().alias("pop")).agg(F.count("cv").alias("units"), rounded(F.avg("cv")).alias("cv"))


@query(
    "cv_isi_compat",
    f"""WITH {EV}, s AS (SELECT u, event_id, (t - {T0}) // {HOUR} AS step FROM ev),
    d AS (SELECT u, step - coalesce(lag(step) OVER (PARTITION BY u ORDER BY event_id), -1) AS d FROM s),
    cv AS (SELECT u, CASE WHEN count(*) >= 3 THEN stddev_pop(d) / nullif(avg(d), 0) END AS cv FROM d GROUP BY u)
    SELECT {POP} AS pop, count(cv) AS units, round(avg(cv), 6) AS cv FROM cv GROUP BY 1""",
)
def cv_isi_compat(spark: SparkSession, sf: str) -> DataFrame:
    steps = events(spark, sf).select("u", "event_id", floor_div(F.col("t") - T0, HOUR).alias("step"))
    per_unit = rates.interval_cv_compat(steps, event_track(spark, sf), "step")
    return per_unit.groupBy(pop_of().alias("pop")).agg(F.count("cv").alias("units"), rounded(F.avg("cv")).alias("cv"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    return ev.groupBy("u", floor_div(F.col("t") - T0, HOUR).alias("h")).agg(F.count("*").alias("c"))


GRID_SQL = f"""grid AS (SELECT us.u, h.h FROM (SELECT DISTINCT u FROM ev) us CROSS JOIN (SELECT unnest(range(0, {DAYS_SQL} * 24)) AS h) h),
    c AS (SELECT u, (t - {BASE_SQL}) // {HOUR} AS h, count(*) AS c FROM ev GROUP BY 1, 2),
    g AS (SELECT grid.u, grid.h, coalesce(c.c, 0) AS c FROM grid LEFT JOIN c USING (u, h)),
    gp AS (SELECT *, {POP} AS pop FROM g UNION ALL SELECT *, 'total' AS pop FROM g),
    uv AS (SELECT pop, u, var_pop(c) AS v FROM gp GROUP BY pop, u),
    us2 AS (SELECT pop, sum(v) AS v, count(*) AS units FROM uv GROUP BY pop),
    m AS (SELECT pop, h, avg(c) AS m FROM gp GROUP BY pop, h),
    mv AS (SELECT pop, var_pop(m) AS mv FROM m GROUP BY pop),
    chi AS (SELECT pop, units, sqrt(mv * units / v) AS chi FROM us2 JOIN mv USING (pop))"""


@query("chi_sync", f"WITH {EV}, {GRID_SQL} SELECT pop, units, round(chi, 6) AS chi FROM chi")
def chi_sync(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.chi_synchrony(in_pops(hourly(spark, sf)), "pop", "u", "h", days(spark, sf) * 24)
    return out.select("pop", "units", rounded("chi").alias("chi"))


@query(
    "run_summary",
    f"""WITH {EV}, {CV_SQL}, {GRID_SQL},
    cp AS (SELECT *, {POP} AS pop FROM cv UNION ALL SELECT *, 'total' AS pop FROM cv),
    s AS (SELECT pop, avg(cv) AS cv, avg(events) / any_value({DAYS_SQL} * 24) AS frs_m, stddev_pop(events) / any_value({DAYS_SQL} * 24) AS frs_s
          FROM cp GROUP BY pop)
    SELECT pop, round(chi, 6) AS chi, round(cv, 6) AS cv, round(frs_m, 9) AS frs_m, round(frs_s, 9) AS frs_s
    FROM s JOIN chi USING (pop)""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row per population and one for the total, as a run is summarised."""
    hours = days(spark, sf) * 24
    per_unit = in_pops(rates.interval_cv(events(spark, sf).select("u", "event_id", "t"), event_track(spark, sf), "t"))
    basic = per_unit.groupBy("pop").agg(
        rounded(F.avg("cv")).alias("cv"),
        rounded(F.avg("events") / hours, 9).alias("frs_m"),
        rounded(F.stddev_pop("events") / hours, 9).alias("frs_s"),
    )
    return chi_sync(spark, sf).drop("units").join(basic, "pop")


@query(
    "spike_sync",
    f"""WITH {EV}, p AS (SELECT DISTINCT u, {POP} AS pop, (t - {T0}) // {DAY} AS b FROM ev),
    n AS (SELECT u, pop, count(*) AS n FROM p GROUP BY u, pop),
    o AS (SELECT a.u AS i, c.u AS j, count(*) AS o FROM p a JOIN p c ON a.b = c.b GROUP BY 1, 2),
    pr AS (SELECT ni.pop AS pop_i, nj.pop AS pop_j, coalesce(o.o, 0) / sqrt(ni.n * nj.n) AS c
           FROM n ni JOIN n nj ON ni.pop < nj.pop OR (ni.pop = nj.pop AND ni.u <= nj.u)
           LEFT JOIN o ON o.i = ni.u AND o.j = nj.u)
    SELECT pop_i, pop_j, round(avg(c), 6) AS sync FROM pr GROUP BY pop_i, pop_j""",
)
def spike_sync(spark: SparkSession, sf: str) -> DataFrame:
    p = events(spark, sf).select("u", pop_of().alias("pop"), floor_div(F.col("t") - T0, DAY).alias("b")).distinct()
    return rates.pair_synchrony(p, "pop", "u", "b").withColumn("sync", rounded("sync"))


@query(
    "weighted_total_signal",
    """WITH s AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v, count(*) AS n FROM customer GROUP BY 1)
    SELECT CAST(k AS VARCHAR) AS pop, n AS units, round(v, 4) AS v FROM s UNION ALL
    SELECT 'total', CAST(sum(n) AS BIGINT), round(sum(v * n) / sum(n), 4) FROM s""",
)
def weighted_total_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Mean signal per population and their size-weighted total in one pass."""
    return (
        table(spark, sf, "customer", "c_nationkey", "c_acctbal")
        .rollup("c_nationkey")
        .agg(F.count("*").alias("units"), rounded(F.avg("c_acctbal"), 4).alias("v"))
        .select(F.coalesce(F.col("c_nationkey").cast("string"), F.lit("total")).alias("pop"), "units", "v")
    )


@query(
    "nan_aware_stats",
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(d) AS n, round(avg(d), 9) AS m,
    round(stddev_pop(d), 9) AS s FROM (SELECT *, CASE WHEN l_discount <= 0.08 THEN l_discount END AS d FROM lineitem)
    GROUP BY 1, 2""",
)
def nan_aware_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Null out outliers, then average what is left."""
    d = F.when(F.col("l_discount") <= 0.08, F.col("l_discount"))
    return (
        table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_discount")
        .groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
        .agg(F.count(d).alias("n"), rounded(F.avg(d), 9).alias("m"), rounded(F.stddev_pop(d), 9).alias("s"))
    )


@query(
    "sweep_moments",
    """SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS BIGINT) AS line,
    round(avg(l_quantity), 6) AS m, round(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 6) AS v
    FROM lineitem GROUP BY 1, 2, 3""",
)
def sweep_moments(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return (
        table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
        .groupBy(
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_linenumber").cast("bigint").alias("line"),
        )
        .agg(rounded(F.avg(q)).alias("m"), rounded(F.avg(q * q) - F.avg(q) * F.avg(q)).alias("v"))
    )


@query(
    "lead_lag_ratio",
    f"""WITH {EV}, nx AS (SELECT u, kind, t,
      min(CASE WHEN kind = 'view' THEN t END) OVER w AS v, min(CASE WHEN kind = 'error' THEN t END) OVER w AS e
      FROM ev WINDOW w AS (PARTITION BY u ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    tau AS (SELECT {POP} AS pop, v - e AS tau FROM nx WHERE kind = 'click'),
    s AS (SELECT pop, count(tau) AS n, count(*) FILTER (tau > 0) AS p, count(*) FILTER (tau < 0) AS m,
          count(*) FILTER (abs(tau) > 1000) AS far FROM tau GROUP BY pop)
    SELECT pop, n, round(CASE WHEN far / n > 0.1 THEN (p - m) / n ELSE 0.0 END, 9) AS ratio,
    round(CASE WHEN far / n > 0.1 THEN far / n ELSE 0.0 END, 9) AS far_share FROM s""",
)
def lead_lag_ratio(spark: SparkSession, sf: str) -> DataFrame:
    marks = {"view": F.col("kind") == "view", "error": F.col("kind") == "error"}
    ev = events(spark, sf).select("u", "event_id", "t", "kind")
    tau = (
        rates.next_times(ev, event_track(spark, sf), marks, "t")
        .filter("kind = 'click'")
        .select(pop_of().alias("pop"), (F.col("view") - F.col("error")).alias("tau"))
    )
    return rates.lead_lag(tau, "pop", "tau", far=1000).select(
        "pop", "n", rounded("ratio", 9).alias("ratio"), rounded("far_share", 9).alias("far_share")
    )


@query(
    "circular_phase",
    f"""WITH {EV}, p AS (SELECT kind, 2 * pi() * ((t - {T0}) % {DAY}) / {DAY} AS p FROM ev)
    SELECT kind, round(atan2(avg(sin(p)), avg(cos(p))), 6) AS phase,
    round(1 - (avg(cos(p)) ** 2 + avg(sin(p)) ** 2), 6) AS dispersion FROM p GROUP BY kind""",
)
def circular_phase(spark: SparkSession, sf: str) -> DataFrame:
    p = F.lit(2.0) * F.pi() * F.pmod(F.col("t") - T0, F.lit(DAY)) / DAY
    return (
        events(spark, sf)
        .select("kind", p.alias("p"))
        .groupBy("kind")
        .agg(rounded(circular_mean(F.col("p"))).alias("phase"), rounded(circular_dispersion(F.col("p"))).alias("dispersion"))
    )


@query(
    "angle_spread_compat",
    f"""WITH {EV}, p AS (SELECT kind, 2 * pi() * ((t - {T0}) % {DAY}) / {DAY} - pi() AS p FROM ev)
    SELECT kind, round(atan2(avg(sin(p * p)), avg(cos(p * p))) - atan2(avg(sin(p)), avg(cos(p))) ** 2, 6) AS spread FROM p GROUP BY kind""",
)
def angle_spread(spark: SparkSession, sf: str) -> DataFrame:
    """The older spread of the time of day, for comparison with earlier figures."""
    p = F.lit(2.0) * F.pi() * F.pmod(F.col("t") - T0, F.lit(DAY)) / DAY - F.pi()
    return events(spark, sf).groupBy("kind").agg(rounded(angle_spread_compat(p)).alias("spread"))


@query(
    "population_bands",
    f"""WITH {EV} SELECT {POP} AS pop, count(*) FILTER (CASE WHEN u % 2 = 0 THEN x > 50 ELSE x < 40 END) AS inside, count(*) AS n,
    round(avg(CASE WHEN x > 0 THEN 1000 / x ELSE 30 END) FILTER (CASE WHEN u % 2 = 0 THEN x > 50 ELSE x < 40 END), 6) AS period FROM ev GROUP BY 1""",
)
def population_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts inside the band of their own population, and their mean period."""
    ev = events(spark, sf).select(pop_of().alias("pop"), "x")
    ok = in_band("x", "pop", {"F": (50.0, None), "S": (None, 40.0)})
    period = rounded(F.avg(F.when(ok, period_ms("x"))))
    return ev.groupBy("pop").agg(F.count_if(ok).alias("inside"), F.count("*").alias("n"), period.alias("period"))

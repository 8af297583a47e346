"""Queries: quantiles, tests, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import inference, segments
from spiketide.operators.ordered import Track
from spiketide.plans.clusters import SIL, scored
from spiketide.plans.rates import EV, POP, pop_of
from spiketide.plans.registry import query
from spiketide.plans.tables import HOUR, T0, events
from spiketide.session import stage

HOD = f"((t - {T0}) // {HOUR}) % 24"


def hour_of_day():
    return F.expr(f"((t - {T0}) div {HOUR}) % 24")


@query(
    "conf_interval_overlap",
    f"""WITH {EV}, q AS (SELECT kind, {HOD} AS h, {POP} AS pop, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM ev GROUP BY 1, 2, 3)
    SELECT a.kind, a.h, round(a.lo, 6) AS lo_a, round(a.hi, 6) AS hi_a, round(b.lo, 6) AS lo_b, round(b.hi, 6) AS hi_b,
    a.lo > b.hi OR a.hi < b.lo AS differs FROM q a JOIN q b ON a.kind = b.kind AND a.h = b.h AND a.pop = 'F' AND b.pop = 'S'""",
)
def conf_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval test on a grid of (mark, hour of day): population F against S."""
    df = events(spark, sf).select("kind", hour_of_day().alias("h"), pop_of().alias("pop"), "x")
    out = inference.interval_overlap(df, ["kind", "h"], "pop", "F", "S", "x").filter("lo_a IS NOT NULL AND lo_b IS NOT NULL")
    return out.select("kind", "h", *[rounded(c).alias(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")], "differs")


@query(
    "error_band",
    """SELECT event_type AS kind, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS med,
    round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS lo,
    round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS hi FROM events GROUP BY 1""",
)
def error_band(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("kind", "x")
    q = inference.wide_quantiles(ev, ["kind"], "x", {"p5": 0.05, "med": 0.5, "p95": 0.95})
    half = F.lit(1.96) * F.stddev_pop("x") / F.sqrt(F.count("*"))
    m = ev.groupBy("kind").agg(rounded(F.avg("x") - half).alias("lo"), rounded(F.avg("x") + half).alias("hi"))
    return q.select("kind", *[rounded(c).alias(c) for c in ("p5", "med", "p95")]).join(m, "kind")


@query(
    "percentile_threshold_mask",
    """WITH q AS (SELECT event_type AS kind, quantile_cont(value, 0.95) AS q FROM events GROUP BY 1)
    SELECT kind, count(*) FILTER (value > q) AS above, round(count(*) FILTER (value > q) / count(*), 9) AS share
    FROM events JOIN q ON kind = event_type GROUP BY kind""",
)
def percentile_threshold_mask(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("kind", "x")
    q = stage(inference.exact_quantiles(ev, ["kind"], "x", [0.95]))
    return ev.join(q, "kind").groupBy("kind").agg(
        F.count_if(F.col("x") > F.col("q")).alias("above"), rounded(F.count_if(F.col("x") > F.col("q")) / F.count("*"), 9).alias("share")
    )


@query(
    "clipped_minmax",
    """WITH q AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, event_type AS kind FROM events GROUP BY kind)
    SELECT event_id, round(least(1.0, greatest(0.0, (value - lo) / (hi - lo))), 6) AS scaled FROM events JOIN q ON kind = event_type""",
)
def clipped_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """Scale to [0, 1] between the 10 and 90 percent quantiles of the own group."""
    ev = events(spark, sf).select("event_id", "kind", "x")
    q = stage(inference.wide_quantiles(ev, ["kind"], "x", {"lo": 0.1, "hi": 0.9}))
    z = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return ev.join(q, "kind").select("event_id", rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), z))).alias("scaled"))


@query(
    "zscore",
    """WITH s AS (SELECT event_type AS kind, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
    SELECT event_id, round((value - m) / s, 6) AS z FROM events JOIN s ON kind = event_type""",
)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Standardise per group: moments are aggregated first, then joined, so no group is held whole.

    The moments are a written table, so Spark knows their size before it plans
    the join and broadcasts them only if they are small.
    """
    ev = events(spark, sf).select("event_id", "kind", "x")
    s = stage(ev.groupBy("kind").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")))
    return ev.join(s, "kind").select("event_id", rounded((F.col("x") - F.col("m")) / F.col("s")).alias("z"))


@query(
    "t_statistic",
    f"""WITH {EV}, o AS (SELECT kind, count(*) AS n, (avg(x) - 34.0) / (stddev_samp(x) / sqrt(count(*))) AS t1 FROM ev GROUP BY 1),
    w AS (SELECT kind, count(*) FILTER (u % 2 = 0) AS na, count(*) FILTER (u % 2 = 1) AS nb,
      avg(x) FILTER (u % 2 = 0) AS ma, avg(x) FILTER (u % 2 = 1) AS mb,
      var_samp(x) FILTER (u % 2 = 0) AS va, var_samp(x) FILTER (u % 2 = 1) AS vb FROM ev GROUP BY 1)
    SELECT kind, n, round(t1, 6) AS t1, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
      * (1 / na + 1 / nb)), 6) AS t2 FROM o JOIN w USING (kind)""",
)
def t_statistic(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("kind", "x", (F.col("u") % 2 == 0).alias("first"))
    one = inference.one_sample_t(ev, ["kind"], "x", 34.0).select("kind", "n", rounded("t").alias("t1"))
    return one.join(inference.two_sample_t(ev, ["kind"], "x", "first").select("kind", rounded("t").alias("t2")), "kind")


@query("t_test_p")
def t_test_p(spark: SparkSession, sf: str) -> DataFrame:
    """t per hour of day and mark against a fixed mean, with its p-value (not available in SQL)."""
    ev = events(spark, sf).select("kind", hour_of_day().alias("h"), "x")
    t = inference.one_sample_t(ev, ["kind", "h"], "x", 34.0)
    return t.select("kind", "h", "n", "t", inference.t_p_value("t", "dof").alias("p"))


@query(
    "significant_sign_runs",
    f"""WITH {EV}, o AS (SELECT kind, {HOD} AS h, (avg(x) - 34.0) / (stddev_samp(x) / sqrt(count(*))) AS t FROM ev GROUP BY 1, 2),
    s AS (SELECT kind, h, CASE WHEN abs(t) > 0.8 THEN CAST(sign(t) AS BIGINT) ELSE 0 END AS s FROM o),
    g AS (SELECT *, h - row_number() OVER (PARTITION BY kind, s ORDER BY h) AS g FROM s)
    SELECT kind, min(h) AS "start", max(h) + 1 AS "end", s AS state FROM g WHERE s <> 0 GROUP BY kind, s, g""",
)
def significant_sign_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Merge neighbouring significant lags of equal sign."""
    ev = events(spark, sf).select("kind", hour_of_day().alias("h"), "x")
    t = inference.one_sample_t(ev, ["kind", "h"], "x", 34.0)
    state = F.when(F.abs("t") > 0.8, F.signum("t").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    grid = t.select("kind", "h", state.alias("state"))
    return segments.runs(grid, Track(("kind",), "h", 64, flat=True), "state").filter("state <> 0")


@query(
    "perm_test",
    f"""WITH {EV}, p AS (SELECT event_id, x, kind = 'click' AS f FROM ev WHERE kind IN ('click', 'view')),
    r AS (SELECT r.r, p.x, row_number() OVER (PARTITION BY r.r ORDER BY ((('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 2147483647)
        * (('0x' || substr(md5('split:' || r.r), 1, 8))::BIGINT % 2147483646 + 1)) % 2147483647, event_id) AS k
      FROM p CROSS JOIN range(0, 1000) r(r)), nx AS (SELECT count(*) FILTER (f) AS nx, avg(x) FILTER (f) - avg(x) FILTER (NOT f) AS dm FROM p),
    d AS (SELECT r, avg(x) FILTER (k <= nx) - avg(x) FILTER (k > nx) AS d FROM r, nx GROUP BY r),
    q AS (SELECT quantile_cont(d, 0.01) AS lo, quantile_cont(d, 0.99) AS hi FROM d)
    SELECT 'click-view' AS pair, round(dm, 6) AS dm, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > dm OR hi < dm AS differs FROM q, nx""",
)
def perm_test(spark: SparkSession, sf: str) -> DataFrame:
    df = (
        events(spark, sf)
        .filter(F.col("kind").isin("click", "view"))
        .select(F.lit("click-view").alias("pair"), "event_id", "x", (F.col("kind") == "click").alias("first"))
    )
    out = inference.permutation_test(df, ["pair"], "event_id", "x", "first", rounds=1000)
    return out.select("pair", *[rounded(c).alias(c) for c in ("dm", "lo", "hi")], "differs")


@query(
    "top_percent_softmax",
    f"""WITH {SIL}, q AS (SELECT label, quantile_cont(s, 0.75) AS q FROM sil GROUP BY label),
    c AS (SELECT label, vec_id, exp(s) AS w, sum(exp(s)) OVER (PARTITION BY label ORDER BY vec_id) AS hi FROM sil JOIN q USING (label) WHERE s >= q),
    r AS (SELECT label, vec_id, floor((hi - w) / max(hi) OVER (PARTITION BY label) * 1099511627776) AS lo FROM c),
    dw AS (SELECT l.label, d.d AS draw, ('0x' || substr(md5(l.label || ':42:' || d.d), 1, 8))::BIGINT * 256 AS pos
      FROM (SELECT DISTINCT label FROM p) l CROSS JOIN range(0, 200) d(d))
    SELECT dw.label, draw, arg_max(vec_id, lo) AS vec_id FROM dw JOIN r ON r.label = dw.label AND r.lo <= dw.pos GROUP BY 1, 2""",
)
def top_percent_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """200 weighted draws per label among the points in the top quarter of its silhouettes."""
    pts = stage(scored(spark, sf).select("label", "vec_id", F.col("s").alias("score")))
    out = inference.softmax_draws(pts, ["label"], "vec_id", "score", top=0.25, draws=200, seed=42)
    return out.withColumn("draw", F.col("draw").cast("bigint"))


@query(
    "best_mid_worst",
    f"""WITH {SIL}, r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY s, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM sil)
    SELECT label, vec_id, CASE WHEN k <= 2 THEN 'worst' WHEN k > n - 2 THEN 'best' ELSE 'mid' END AS pick
    FROM r WHERE k <= 2 OR k > n - 2 OR k IN (n // 2, n // 2 + 1)""",
)
def best_mid_worst(spark: SparkSession, sf: str) -> DataFrame:
    """The two lowest, two middle and two highest silhouettes of each label."""
    from spiketide.operators.clusters import picks

    pts = stage(scored(spark, sf).select("label", "vec_id", F.col("s").alias("score")))
    return picks(pts, "label", "vec_id", "score", 2)

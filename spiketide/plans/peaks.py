"""Queries: peaks by prominence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import peaks
from spiketide.operators.ordered import Track, find_hot, ordinal
from spiketide.plans.rates import SER
from spiketide.plans.registry import query
from spiketide.plans.tables import chunk_width, events, series

MERGED = "CASE WHEN user_id % 10 < 6 THEN -1 ELSE user_id END"


def prominence_sql(ser: str) -> str:
    return f"""WITH {ser},
    runs AS MATERIALIZED (SELECT u, min(n) AS s, max(n) AS e, x AS v FROM (SELECT u, n, x, n - row_number() OVER (PARTITION BY u, x ORDER BY n) AS g FROM ser) GROUP BY u, x, g),
    pk AS MATERIALIZED (SELECT u, s, e, v FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM runs WINDOW w AS (PARTITION BY u ORDER BY s)) WHERE v > l AND v > r),
    lim AS MATERIALIZED (SELECT p.u, p.s, max(q.s) FILTER (q.s < p.s AND q.v > p.v) AS lo, min(q.s) FILTER (q.s > p.s AND q.v > p.v) AS hi
      FROM pk p JOIN runs q ON q.u = p.u GROUP BY p.u, p.s),
    lft AS (SELECT p.u, p.s, min(q.v) AS low, max(q.e) AS base FROM (
      SELECT lim.u, lim.s, q.v, q.e, min(q.v) OVER (PARTITION BY lim.u, lim.s) AS m FROM lim JOIN runs q ON q.u = lim.u AND q.s < lim.s AND q.s > coalesce(lo, -1)) q
      JOIN pk p ON p.u = q.u AND p.s = q.s WHERE q.v = m GROUP BY p.u, p.s),
    rgt AS (SELECT u, s, min(v) AS low, min(qs) AS base FROM (
      SELECT lim.u, lim.s, q.v, q.s AS qs, min(q.v) OVER (PARTITION BY lim.u, lim.s) AS m FROM lim JOIN runs q ON q.u = lim.u AND q.s > lim.s AND (hi IS NULL OR q.s < hi))
      WHERE v = m GROUP BY u, s)
    SELECT pk.u, (pk.s + pk.e) // 2 AS n, pk.s AS "left", pk.e AS "right", pk.v AS value, round(pk.v - greatest(lft.low, rgt.low), 6) AS prominence,
      lft.base AS left_base, rgt.base AS right_base FROM pk JOIN lft ON lft.u = pk.u AND lft.s = pk.s JOIN rgt ON rgt.u = pk.u AND rgt.s = pk.s"""


@query("peak_prominence", prominence_sql(SER))
def peak_prominence(spark: SparkSession, sf: str) -> DataFrame:
    """Every peak of the sampled signals with its plateau, prominence and bases."""
    ser, tr = series(spark, sf, "x")
    return peaks.peaks(ser, tr, "x").withColumn("prominence", rounded("prominence"))


ONE_UNIT = f"ser AS (SELECT u, row_number() OVER (PARTITION BY u ORDER BY event_id) - 1 AS n, x FROM (SELECT {MERGED} AS u, event_id, value AS x FROM events))"


@query("peak_prominence_hot", prominence_sql(ONE_UNIT))
def peak_prominence_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same where one unit holds the events of six in ten users."""
    u = F.when(F.col("u") % 10 < 6, F.lit(-1).cast("bigint")).otherwise(F.col("u"))
    ev = events(spark, sf).select(u.alias("u"), "event_id", "x")
    width = chunk_width(spark, sf, "events")
    hot, flat = find_hot(ev.select("u"), ["u"], width)
    track = Track(("u",), "event_id", width, hot=hot, flat=flat)
    return peaks.peaks(ordinal(ev, track), track.at("n"), "x").withColumn("prominence", rounded("prominence"))

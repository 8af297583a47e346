"""Queries: estimates over drawn or single chunks of signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import chunked
from spiketide.plans.joins import BINNED, _binned
from spiketide.plans.rates import SER
from spiketide.plans.registry import query
from spiketide.plans.replicates import te_sql
from spiketide.plans.tables import series

SIZE, LAGS, ROUNDS, DRAWS, SEED = 16, 6, 100, 400, 23

CHUNKS = f"""{BINNED}, ch AS MATERIALIZED (SELECT u, n, xb, yb, n // {SIZE} AS c FROM bn JOIN (SELECT u, count(*) AS len FROM bn GROUP BY u) USING (u) WHERE (n // {SIZE} + 1) * {SIZE} <= len),
    rk AS MATERIALIZED (SELECT u, c, row_number() OVER (ORDER BY u, c) - 1 AS rank, count(*) OVER () AS m FROM (SELECT DISTINCT u, c FROM ch)),
    dr AS MATERIALIZED (SELECT r.r AS round, CAST('0x' || substr(md5(r.r || ':' || d.d || ':{SEED}'), 1, 8) AS BIGINT) % m AS rank, count(*) AS times
      FROM range(0, {ROUNDS}) r(r) CROSS JOIN range(0, {DRAWS}) d(d) CROSS JOIN (SELECT DISTINCT m FROM rk) GROUP BY ALL),
    pr AS (SELECT a.u, a.c, b.n - a.n AS lag, a.xb AS x0, a.yb AS y0, b.xb AS x1, b.yb AS y1 FROM ch a JOIN ch b ON a.u = b.u AND a.c = b.c AND b.n - a.n BETWEEN 1 AND {LAGS}),
    lj AS MATERIALIZED (SELECT u, c, lag, 0::BIGINT AS dir, y1 AS now, y0 AS "then", x0 AS src, count(*) AS n FROM pr GROUP BY ALL
      UNION ALL SELECT u, c, lag, 1::BIGINT, x1, x0, y0, count(*) FROM pr GROUP BY ALL),
    bs AS (SELECT round, lag, dir, now, "then", src, sum(n * times) AS n FROM lj JOIN rk USING (u, c) JOIN dr USING (rank) GROUP BY ALL)"""


@query("te_chunk_bootstrap", f"WITH {CHUNKS}, {te_sql('te', 'bs')} SELECT round, lag, dir, round(te, 8) AS te FROM te")
def te_chunk_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer entropy of 400 chunks drawn anew in each of 100 rounds."""
    df, tr = _binned(spark, sf)
    return chunked.chunk_bootstrap(df, tr, "xb", "yb", SIZE, LAGS, ROUNDS, DRAWS, SEED).withColumn("te", rounded("te", 8))


@query(
    "te_chunk_interval",
    f"""WITH {CHUNKS}, {te_sql('te', 'bs')} SELECT lag, dir, round(avg(te), 8) AS mean, round(quantile_cont(te, 0.05), 8) AS lo, round(quantile_cont(te, 0.95), 8) AS hi
    FROM te GROUP BY lag, dir""",
)
def te_chunk_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and the 5 to 95 % interval of the bootstrapped transfer entropy, per lag and direction."""
    df, tr = _binned(spark, sf)
    te = chunked.chunk_bootstrap(df, tr, "xb", "yb", SIZE, LAGS, ROUNDS, DRAWS, SEED)
    q = F.percentile("te", F.array(F.lit(0.05), F.lit(0.95)))  # one value a round
    out = te.groupBy("lag", "dir").agg(F.avg("te").alias("mean"), q.alias("q"))
    return out.select("lag", "dir", rounded("mean", 8).alias("mean"), rounded(F.col("q")[0], 8).alias("lo"), rounded(F.col("q")[1], 8).alias("hi"))


AIS_SIZE, AIS_LAGS = 20, range(1, 6)


@query(
    "active_information_chunks",
    f"""WITH {SER}, s AS (SELECT u, n, x, n // {AIS_SIZE} AS c FROM ser JOIN (SELECT u, count(*) AS len FROM ser GROUP BY u) USING (u) WHERE (n // {AIS_SIZE} + 1) * {AIS_SIZE} <= len),
    r AS (SELECT a.u, a.c, b.n - a.n AS lag, corr(a.x, b.x) AS r FROM s a JOIN s b ON a.u = b.u AND a.c = b.c AND b.n - a.n BETWEEN 1 AND {max(AIS_LAGS)}
      WHERE a.n % {AIS_SIZE} < {AIS_SIZE - max(AIS_LAGS)} GROUP BY ALL)
    SELECT lag, count(*) AS chunks, round(avg((({chunked.digamma_sql(str((AIS_SIZE - max(AIS_LAGS)) / 2 - 1))} - {chunked.digamma_sql(str((AIS_SIZE - max(AIS_LAGS)) / 2 - 0.5))}) / 2
      - ln(1 - r * r) / 2) / {math.log(2)!r}), 8) AS ais FROM r WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) < 1 GROUP BY lag""",
)
def active_information_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Active information storage with the bias term, averaged over chunks of 20 samples."""
    ser, tr = series(spark, sf, "x")
    return chunked.active_information(ser, tr, "x", AIS_SIZE, list(AIS_LAGS)).withColumn("ais", rounded("ais", 8))

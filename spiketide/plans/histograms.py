"""Queries: histograms and contingency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import bin_of, rounded
from spiketide.operators import hist
from spiketide.plans.rates import EV
from spiketide.plans.registry import query
from spiketide.plans.tables import DAY, T0, events, table

QTY = "CAST(floor(l_quantity / 5) AS BIGINT) AS q"
DISC = "CAST(floor(round(l_discount * 100) / 2) AS BIGINT) AS d"
TAX = "CAST(floor(round(l_tax * 100) / 2) AS BIGINT) AS x"
BINS = {
    "q": lambda: bin_of("l_quantity", 0, 5, 10),
    "d": lambda: bin_of(F.round(F.col("l_discount") * 100), 0, 2, 5),
    "x": lambda: bin_of(F.round(F.col("l_tax") * 100), 0, 2, 4),
}


def _hist(spark: SparkSession, sf: str, *axes: str) -> DataFrame:
    src = table(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax")
    return hist.histogram(src, {a: BINS[a]() for a in axes})


@query("hist1d", f"SELECT q, count(*) AS n FROM (SELECT {QTY} FROM lineitem) WHERE q < 10 GROUP BY q")
def hist1d(spark: SparkSession, sf: str) -> DataFrame:
    return _hist(spark, sf, "q")


@query(
    "hist2d_half_open",
    f"SELECT q, d, count(*) AS n FROM (SELECT {QTY}, {DISC} FROM lineitem) WHERE q < 10 AND d < 5 GROUP BY q, d",
)
def hist2d(spark: SparkSession, sf: str) -> DataFrame:
    return _hist(spark, sf, "q", "d")


@query(
    "hist3d",
    f"""SELECT q, d, x, count(*) AS n FROM (SELECT {QTY}, {DISC}, {TAX} FROM lineitem)
    WHERE q < 10 AND d < 5 AND x < 4 GROUP BY q, d, x""",
)
def hist3d(spark: SparkSession, sf: str) -> DataFrame:
    return _hist(spark, sf, "q", "d", "x")


@query(
    "phase_hist",
    f"""WITH {EV}, p AS (SELECT kind, 2 * pi() * ((t - {T0}) % {DAY}) / {DAY} - pi() AS p FROM ev)
    SELECT kind, least(CAST(floor((p + pi()) / (2 * pi() / 20)) AS BIGINT), 19) AS b, count(*) AS n FROM p GROUP BY 1, 2""",
)
def phase_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Phase in twenty bins on [-pi, pi]; pi itself belongs to the last bin."""
    p = F.lit(2.0) * F.pi() * F.pmod(F.col("t") - T0, F.lit(DAY)) / DAY - F.pi()
    b = F.least(F.floor((p + F.pi()) / (F.lit(2.0) * F.pi() / 20)), F.lit(19).cast("bigint"))
    return hist.histogram(events(spark, sf), {"b": b}, by=["kind"])


@query(
    "outer_count",
    """SELECT x, y, nx * ny AS n FROM (SELECT CAST(quality AS BIGINT) AS x, count(*) AS nx FROM labels GROUP BY 1),
    (SELECT CAST(toxic AS BIGINT) AS y, count(*) AS ny FROM labels GROUP BY 1)""",
)
def outer_count(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "labels", "quality", "toxic")
    x = hist.histogram(src, {"b": F.col("quality").cast("bigint")})
    y = hist.histogram(src, {"b": F.col("toxic").cast("bigint")})
    return hist.outer_counts(x, y)


CONT = """c AS (SELECT CAST(quality AS BIGINT) AS a, CAST(toxic AS BIGINT) AS b, count(*) AS n FROM labels GROUP BY 1, 2)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "labels", "quality", "toxic")
    return hist.contingency(
        src.select(F.col("quality").cast("bigint").alias("a"), F.col("toxic").cast("bigint").alias("b")), "a", "b"
    )


@query("contingency_table", f"WITH {CONT} SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS share FROM c")
def contingency_table(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).withColumn("share", rounded("share", 9))


@query(
    "adjusted_rand",
    f"""WITH {CONT}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS i,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS j, (SELECT sum(n) FROM c) AS m)
    SELECT round((ij - i * j / (m * (m - 1) / 2)) / ((i + j) / 2 - i * j / (m * (m - 1) / 2)), 9) AS ari FROM s""",
)
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return hist.adjusted_rand(_labels(spark, sf), "a", "b").select(rounded("ari", 9).alias("ari"))


@query(
    "adjusted_mutual_info",
    f"""WITH {CONT}, ra AS (SELECT a, sum(n)::DOUBLE AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n)::DOUBLE AS nb FROM c GROUP BY b),
    t AS (SELECT sum(n)::DOUBLE AS m FROM c),
    mi AS (SELECT sum(n / m * ln(n * m / (na * nb))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), t),
    h AS (SELECT (SELECT -sum(na / m * ln(na / m)) FROM ra, t) AS ha, (SELECT -sum(nb / m * ln(nb / m)) FROM rb, t) AS hb),
    k AS (SELECT na, nb, m, unnest(range(greatest(1, (na + nb - m)::BIGINT), least(na, nb)::BIGINT + 1)) AS k FROM ra, rb, t),
    e AS (SELECT sum(k / m * ln(k * m / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(m - na + 1)
      + lgamma(m - nb + 1) - lgamma(m + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1)
      - lgamma(m - na - nb + k + 1))) AS emi FROM k)
    SELECT round(mi, 8) AS mi, round(emi, 8) AS emi, round((mi - emi) / ((ha + hb) / 2 - emi), 8) AS ami FROM mi, h, e""",
)
def adjusted_mutual_info(spark: SparkSession, sf: str) -> DataFrame:
    out = hist.adjusted_mutual_info(_labels(spark, sf), "a", "b")
    return out.select(*[rounded(c, 8).alias(c) for c in ("mi", "emi", "ami")])


@query(
    "diagonal_sum",
    """WITH c AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS i, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS j,
      count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT i - j AS lag, round(sum(n) / (10 - abs(i - j)) * 10, 6) AS v FROM c WHERE i < 10 AND j < 10 GROUP BY i - j""",
)
def diagonal_sum(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    cells = hist.histogram(src, {"i": bin_of("l_quantity", 0, 5, 10), "j": bin_of("l_extendedprice", 0, 10000, 10)})
    return hist.diagonal_sums(cells, "i", "j", 10).withColumn("v", rounded("v"))


@query(
    "boost_percent",
    """WITH s AS (SELECT event_type AS kind, sum(value) AS s FROM events GROUP BY 1)
    SELECT kind, round((s - b.b) / b.b * 100, 6) AS boost FROM s, (SELECT s AS b FROM s WHERE kind = 'view') b""",
)
def boost_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Percent change of a total against the base group."""
    s = events(spark, sf).groupBy("kind").agg(F.sum("x").alias("s"))
    base = s.filter("kind = 'view'").agg(F.max("s")).scalar()
    return s.withColumn("b", base).select("kind", rounded((F.col("s") - F.col("b")) / F.col("b") * 100).alias("boost"))


@query(
    "expected_count",
    """WITH c AS (SELECT user_id AS u, date_trunc('day', ts) AS d, count(*) AS k FROM events GROUP BY 1, 2),
    h AS (SELECT u, k, count(*) AS m FROM c GROUP BY 1, 2), p AS (SELECT u, k, m / sum(m) OVER (PARTITION BY u) AS p FROM h)
    SELECT u, round(sum(k * p), 6) AS expected FROM p GROUP BY u""",
)
def expected_count(spark: SparkSession, sf: str) -> DataFrame:
    """Expected events per active day, sum of n p(n), per unit."""
    day = F.expr(f"(t - {T0}) div {DAY}")
    per_day = events(spark, sf).groupBy("u", day.alias("d")).agg(F.count("*").alias("k"))
    h = per_day.groupBy("u", "k").agg(F.count("*").alias("m"))
    return h.groupBy("u").agg(rounded(F.sum(F.col("k") * F.col("m")) / F.sum("m")).alias("expected"))

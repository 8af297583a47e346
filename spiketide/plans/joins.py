"""Queries: event-aligned joins, lagged joins, graph edges, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import aligned, lagged
from spiketide.operators.ordered import Track
from spiketide.plans.rates import EV, POP, SER, pop_of
from spiketide.plans.registry import query
from spiketide.plans.tables import HOUR, T0, event_track, events, row_count, series, table

EDGES = [i * HOUR for i in range(25)]
PROBE = f"""pb AS (SELECT event_id, u, b.b, t + b.b * {HOUR} AS s FROM ev CROSS JOIN range(0, 24) b(b) WHERE kind = 'click')"""


def time_track(spark: SparkSession, sf: str) -> Track:
    """Chunks of time that hold about as many rows as a chunk of events."""
    tr = event_track(spark, sf)
    rows = max(1, row_count(spark, sf, "events"))
    low, high = events(spark, sf).agg(F.min("t"), F.max("t")).first()
    return tr.at("t", width=max(1, ((high or 0) - (low or 0)) * tr.width // rows))


def _responses(ev: DataFrame, *marks: str) -> DataFrame:
    return ev.filter(F.col("kind").isin(*marks)).select("u", "t", F.col("kind").alias("mark"))


@query(
    "event_response",
    f"""WITH {EV}, {PROBE}, h AS (SELECT DISTINCT pb.event_id, pb.b FROM pb JOIN ev r ON r.u = pb.u AND r.kind = 'view'
      AND r.t >= pb.s AND r.t < pb.s + {HOUR}),
    n AS (SELECT b, count(*) AS triggers FROM pb GROUP BY b), c AS (SELECT b, count(*) AS hits FROM h GROUP BY b)
    SELECT n.b, coalesce(hits, 0) AS hits, triggers, round(coalesce(hits, 0) / triggers, 9) AS prob FROM n LEFT JOIN c ON c.b = n.b""",
)
def event_response(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of a response in each hour after a trigger."""
    ev = events(spark, sf)
    hits = aligned.presence(
        ev.filter("kind = 'click'").select("u", "t", "event_id"), _responses(ev, "view"), time_track(spark, sf), EDGES, ["view"], "event_id"
    )
    return aligned.response_curve(hits, "view").withColumn("prob", rounded("prob", 9))


@query(
    "event_response_control",
    f"""WITH {EV}, {PROBE}, us AS (SELECT DISTINCT u, u % 2 AS p, (u * 2654435761) % 4294967296 AS h FROM ev),
    pt AS (SELECT a.u, coalesce(arg_min(b.u, b.h) FILTER (b.h >= a.h), arg_min(b.u, b.h)) AS v
           FROM us a JOIN us b ON b.p <> a.p GROUP BY a.u),
    h AS (SELECT DISTINCT pb.event_id, pb.b FROM pb JOIN pt ON pt.u = pb.u JOIN ev r ON r.u = pt.v AND r.kind = 'view'
      AND r.t >= pb.s AND r.t < pb.s + {HOUR}),
    n AS (SELECT b, count(*) AS triggers FROM pb GROUP BY b), c AS (SELECT b, count(*) AS hits FROM h GROUP BY b)
    SELECT n.b, coalesce(hits, 0) AS hits, triggers, round(coalesce(hits, 0) / triggers, 9) AS prob FROM n LEFT JOIN c ON c.b = n.b""",
)
def event_response_control(spark: SparkSession, sf: str) -> DataFrame:
    """The same curve against a pseudo-randomly chosen unit of the other population."""
    ev = events(spark, sf)
    units = ev.select("u").distinct().withColumn("pop", pop_of())
    partner = aligned.control_partner(units, "u", "pop")
    answers = _responses(ev, "view").withColumnRenamed("u", "partner").join(partner, "partner").select("u", "t", "mark")
    hits = aligned.presence(
        ev.filter("kind = 'click'").select("u", "t", "event_id"), answers, time_track(spark, sf), EDGES, ["view"], "event_id"
    )
    return aligned.response_curve(hits, "view").withColumn("prob", rounded("prob", 9))


@query(
    "joint_presence_2x2",
    f"""WITH {EV}, {PROBE},
    h AS (SELECT pb.event_id, pb.b, max(CASE WHEN r.kind = 'view' THEN 1 ELSE 0 END)::BIGINT AS v,
      max(CASE WHEN r.kind = 'error' THEN 1 ELSE 0 END)::BIGINT AS e FROM pb LEFT JOIN ev r ON r.u = pb.u
      AND r.kind IN ('view', 'error') AND r.t >= pb.s AND r.t < pb.s + {HOUR} GROUP BY 1, 2)
    SELECT a.b AS b1, c.b AS b2, a.v AS s1, c.e AS s2, count(*) AS n FROM h a JOIN h c USING (event_id) GROUP BY 1, 2, 3, 4""",
)
def joint_presence_2x2(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    hits = aligned.presence(
        ev.filter("kind = 'click'").select("u", "t", "event_id"), _responses(ev, "view", "error"),
        time_track(spark, sf), EDGES, ["view", "error"], "event_id",
    )
    return aligned.joint_presence(hits, "view", "error", ["u", "event_id"], len(EDGES) - 1)


XB = "least(CAST(floor(x / 20) AS BIGINT), 4)"
YB = f"((t - {T0}) // {HOUR}) % 24 // 6"
BINNED = f"{SER}, bn AS (SELECT u, n, {XB} AS xb, {YB} AS yb FROM ser)"
LAGGED = f"""WITH {BINNED}, pr AS (SELECT b.n - a.n AS lag, a.xb AS x0, a.yb AS y0, b.xb AS x1, b.yb AS y1
      FROM bn a JOIN bn b ON a.u = b.u AND b.n - a.n BETWEEN 1 AND 5),
    lj AS (SELECT lag, 0::BIGINT AS dir, y1 AS now, y0 AS "then", x0 AS src, count(*) AS n FROM pr GROUP BY ALL
      UNION ALL SELECT lag, 1::BIGINT, x1, x0, y0, count(*) FROM pr GROUP BY ALL)"""


def _binned(spark: SparkSession, sf: str):
    ser, tr = series(spark, sf, "x", "t")
    xb = F.least(F.floor(F.col("x") / 20), F.lit(4).cast("bigint"))
    yb = F.expr(f"((t - {T0}) div {HOUR}) % 24 div 6")
    return ser.select("u", "n", xb.alias("xb"), yb.alias("yb")), tr


@query("lagged_joint_hist", f'{LAGGED} SELECT lag, dir, now, "then", src, n FROM lj')
def lagged_joint_hist(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = _binned(spark, sf)
    return lagged.lagged_joint(df, tr, "xb", "yb", 5)


@query(
    "lagged_joint_2d",
    f"""WITH {BINNED}, pr AS (SELECT b.n - a.n AS lag1, c.n - a.n AS lag2, a.xb AS x0, a.yb AS y0, b.xb AS x1, b.yb AS y1,
      c.xb AS x2, c.yb AS y2 FROM bn a JOIN bn b ON a.u = b.u AND b.n - a.n BETWEEN 1 AND 3
      JOIN bn c ON a.u = c.u AND c.n - a.n BETWEEN 1 AND 3)
    SELECT lag1, lag2, 0::BIGINT AS dir, y1 AS a, x2 AS b, y0 AS c, count(*) AS n FROM pr GROUP BY ALL
    UNION ALL SELECT lag1, lag2, 1::BIGINT, x1, y2, x0, count(*) FROM pr GROUP BY ALL""",
)
def lagged_joint_2d(spark: SparkSession, sf: str) -> DataFrame:
    df, tr = _binned(spark, sf)
    return lagged.lagged_joint_2d(df, tr, "xb", "yb", 3)


@query(
    "transfer_entropy",
    f"""{LAGGED}, m AS (SELECT lag, dir, n, sum(n) OVER (PARTITION BY lag, dir) AS a, sum(n) OVER (PARTITION BY lag, dir, "then") AS c,
      sum(n) OVER (PARTITION BY lag, dir, "then", src) AS cs, sum(n) OVER (PARTITION BY lag, dir, now, "then") AS nc FROM lj)
    SELECT lag, dir, round(sum(n / a * log2(n * c / (cs * nc))), 8) AS te FROM m GROUP BY lag, dir""",
)
def transfer_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return lagged.transfer_entropy(lagged_joint_hist(spark, sf)).withColumn("te", rounded("te", 8))


@query(
    "gaussian_ais",
    f"""WITH {SER}, pr AS (SELECT {POP.replace('u %', 'a.u %')} AS pop, b.n - a.n AS lag, a.x AS x0, b.x AS x1 FROM ser a JOIN ser b
      ON a.u = b.u AND b.n - a.n BETWEEN 1 AND 5)
    SELECT pop, lag, count(*) AS n, round(-0.5 * log2(1 - corr(x0, x1) ** 2), 8) AS ais FROM pr GROUP BY pop, lag""",
)
def gaussian_ais(spark: SparkSession, sf: str) -> DataFrame:
    ser, tr = series(spark, sf, "x")
    out = lagged.gaussian_storage(ser.withColumn("pop", pop_of()), tr, "x", range(1, 6), "pop")
    return out.withColumn("ais", rounded("ais", 8))


@query(
    "autocorr_unbiased",
    f"""WITH {SER}, d AS (SELECT u, n, x - avg(x) OVER (PARTITION BY u) AS x FROM ser)
    SELECT a.u, b.n - a.n AS lag, round(avg(a.x * b.x), 5) AS c FROM d a JOIN d b ON a.u = b.u AND b.n - a.n BETWEEN 0 AND 10
    GROUP BY 1, 2""",
)
def autocorr_unbiased(spark: SparkSession, sf: str) -> DataFrame:
    ser, tr = series(spark, sf, "x")
    return lagged.correlation(ser, tr, "x", "x", range(0, 11), scale=False).withColumn("c", rounded("c", 5))


@query(
    "cross_corr",
    f"""WITH {SER}, d AS (SELECT u, n, x - avg(x) OVER w AS x, ((t - {T0}) // {HOUR}) % 24 - avg(((t - {T0}) // {HOUR}) % 24) OVER w AS y
      FROM ser WINDOW w AS (PARTITION BY u)), s AS (SELECT u, stddev_pop(x) * stddev_pop(y) AS s FROM d GROUP BY u)
    SELECT a.u, b.n - a.n AS lag, round(avg(a.x * b.y) / any_value(s.s), 6) AS c
    FROM d a JOIN d b ON a.u = b.u AND b.n - a.n BETWEEN -10 AND 10 JOIN s ON s.u = a.u GROUP BY 1, 2""",
)
def cross_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Value against hour of day, up to ten samples later or earlier."""
    ser, tr = series(spark, sf, "x", "t")
    df = ser.select("u", "n", "x", F.expr(f"cast(((t - {T0}) div {HOUR}) % 24 AS double)").alias("y"))
    return lagged.correlation(df, tr, "x", "y", range(-10, 11), scale=True).withColumn("c", rounded("c"))


@query(
    "edge_propagation",
    """WITH s AS (SELECT o_custkey AS pre, date_diff('day', DATE '1992-01-01', o_orderdate) AS step, count(*) AS a FROM orders GROUP BY 1, 2),
    e AS (SELECT c_custkey AS pre, CAST(c_nationkey AS BIGINT) AS post, c_acctbal AS w, CAST(c_nationkey % 5 AS BIGINT) AS delay FROM customer)
    SELECT post, step + delay AS step, round(sum(w * a), 2) AS input FROM s JOIN e USING (pre) GROUP BY 1, 2""",
)
def edge_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders travel from customer to nation with a delay; weights add up per arrival day."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    spikes = table(spark, sf, "orders", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("pre"), day.alias("step"), F.lit(1).cast("bigint").alias("amplitude")
    )
    nation = F.col("c_nationkey").cast("bigint")
    edges = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(
        F.col("c_custkey").alias("pre"), nation.alias("post"), F.col("c_acctbal").alias("w"), (nation % 5).alias("delay")
    )
    return aligned.propagate(spikes, edges).withColumn("input", rounded("input", 2))


def supply_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem", "l_suppkey", "l_partkey").select(
        F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post")
    ).distinct()


@query("edge_inversion", "SELECT DISTINCT l_partkey AS pre, l_suppkey AS post FROM lineitem")
def edge_inversion(spark: SparkSession, sf: str) -> DataFrame:
    """In-lists to out-lists: the edge table with its ends swapped."""
    return supply_edges(spark, sf).select(F.col("post").alias("pre"), F.col("pre").alias("post"))


@query(
    "degree_counts",
    """WITH e AS (SELECT DISTINCT l_suppkey AS pre, l_partkey AS post FROM lineitem)
    SELECT 'out' AS side, pre AS node, count(*) AS degree FROM e GROUP BY pre
    UNION ALL SELECT 'in', post, count(*) FROM e GROUP BY post""",
)
def degree_counts(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(
        F.struct(F.lit("out").alias("side"), F.col("pre").alias("node")),
        F.struct(F.lit("in").alias("side"), F.col("post").alias("node")),
    )
    return supply_edges(spark, sf).select(F.inline(ends)).groupBy("side", "node").agg(F.count("*").alias("degree"))


@query(
    "resume_anti_join",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS
    (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1997-01-01')""",
)
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs whose output does not exist yet."""
    done = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate").filter(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    jobs = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return jobs.join(done, jobs.o_orderkey == done.l_orderkey, "left_anti")


@query(
    "select_semi_join",
    """SELECT l_suppkey AS pre, count(*) AS n FROM lineitem WHERE EXISTS
    (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 5000) GROUP BY 1""",
)
def select_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of selected nodes only."""
    chosen = table(spark, sf, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 5000")
    e = table(spark, sf, "lineitem", "l_suppkey")
    return e.join(chosen, e.l_suppkey == chosen.s_suppkey, "left_semi").groupBy(F.col("l_suppkey").alias("pre")).agg(F.count("*").alias("n"))


TARGETS = (905.5, 940.04, 1000.0, 1050.05, 1099.99)


@query(
    "nearest_grid",
    f"""SELECT t.x AS target, arg_min(p_partkey, (abs(p_retailprice - t.x), p_partkey)) AS part,
    min(abs(round(p_retailprice - t.x, 6))) AS gap FROM part, (VALUES {', '.join(f'({t}::DOUBLE)' for t in TARGETS)}) t(x) GROUP BY t.x""",
)
def nearest_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Grid point nearest to each target in one pass; ties go to the smaller key."""
    price = F.col("p_retailprice")
    best = [F.min(F.struct(F.abs(price - F.lit(t)).alias("d"), F.col("p_partkey").alias("k"))).alias(f"_{i}") for i, t in enumerate(TARGETS)]
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_{i}.k").alias("part"), rounded(F.col(f"_{i}.d")).alias("gap")) for i, t in enumerate(TARGETS)])
    return table(spark, sf, "part", "p_partkey", "p_retailprice").agg(*best).select(F.inline(rows))

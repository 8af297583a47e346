"""Queries: trigger, receiver and the receiver's targets; drawn controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rank_hash, rounded
from spiketide.operators import aligned, routes
from spiketide.plans.rates import EV
from spiketide.plans.registry import query
from spiketide.plans.tables import HOUR, chunk_width, events, table
from spiketide.session import stage

BINS, MOST_TARGETS, SEED = 8, 5, 17
STEP = 3 * HOUR
EDGES = [i * STEP for i in range(BINS + 1)]


def _hash_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


# every fifth unit triggers; its receiver is drawn among the units its orders lead to; the pair's delay class is trigger % 3
ROUTES = f"""WITH {EV}, nu AS (SELECT max(u) + 1 AS nu FROM ev),
    e AS MATERIALIZED (SELECT DISTINCT o_custkey % nu AS pre, o_orderkey % nu AS post FROM orders CROSS JOIN nu WHERE o_custkey % nu <> o_orderkey % nu),
    sel AS MATERIALIZED (SELECT pre AS trig, post AS recv FROM e WHERE pre % 5 = 0 QUALIFY row_number() OVER (PARTITION BY pre ORDER BY {_hash_sql('pre', 'post', str(SEED))}, post) = 1),
    tr AS MATERIALIZED (SELECT event_id, t, trig, recv FROM ev JOIN sel ON trig = u WHERE kind = 'click')"""


def _seen_sql(name: str, asks: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT q.event_id, q.trig, q.unit, b.b, max(CASE WHEN r.t IS NULL THEN 0 ELSE 1 END)::BIGINT AS s
      FROM ({asks}) q CROSS JOIN range(0, {BINS}) b(b) LEFT JOIN ev r ON r.u = q.unit AND r.kind = 'view' AND r.t >= q.t + b.b * {STEP} AND r.t < q.t + (b.b + 1) * {STEP} GROUP BY ALL)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    units = events(spark, sf).agg(F.max("u") + 1).scalar()
    pre, post = F.pmod("o_custkey", units), F.pmod("o_orderkey", units)
    return table(spark, sf, "orders", "o_custkey", "o_orderkey").select(pre.alias("pre"), post.alias("post")).filter("pre <> post").distinct()


def pairs(spark: SparkSession, sf: str, e: DataFrame) -> DataFrame:
    drawn = e.filter("pre % 5 = 0").withColumn("_seed", F.lit(SEED))
    best = F.min(F.struct(rank_hash("pre", "post", "_seed").alias("h"), "post"))
    return drawn.groupBy(F.col("pre").alias("trigger")).agg(best["post"].alias("receiver"))


def trigger_events(spark: SparkSession, sf: str, sel: DataFrame) -> DataFrame:
    clicks = events(spark, sf).filter("kind = 'click'").select(F.col("event_id").alias("event"), "t", F.col("u").alias("trigger"))
    return clicks.join(sel, "trigger").withColumn("delay", F.col("trigger") % 3).withColumn("side", F.col("trigger") % 2)


def views(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter("kind = 'view'").select(F.col("u").alias("unit"), "t")


@query(
    "route_joint_presence",
    f"""{ROUTES},
    tg AS (SELECT trig, recv, post FROM sel JOIN e ON e.pre = recv WHERE post % 2 = recv % 2
      QUALIFY row_number() OVER (PARTITION BY trig, recv ORDER BY {_hash_sql('trig', 'recv', 'post', str(SEED))}, post) <= {MOST_TARGETS}),
    {_seen_sql('a', 'SELECT event_id, trig, t, recv AS unit FROM tr')},
    {_seen_sql('c', 'SELECT event_id, tr.trig, t, post AS unit FROM tr JOIN tg ON tg.trig = tr.trig')}
    SELECT a.trig % 3 AS delay, a.trig % 2 AS side, a.b AS b1, c.b AS b2, a.s AS s1, c.s AS s2, count(*) AS n FROM a JOIN c ON a.event_id = c.event_id GROUP BY ALL""",
)
def route_joint_presence(spark: SparkSession, sf: str) -> DataFrame:
    """2 x 2 counts of receiver and target answers for each delay class, over up to five targets of the receiver's population."""
    e = stage(edges(spark, sf))
    sel = stage(pairs(spark, sf, e))
    same = F.col("post") % 2 == F.col("receiver") % 2
    targets = stage(routes.sampled_targets(sel, e, MOST_TARGETS, same, SEED))
    return routes.route_counts(trigger_events(spark, sf, sel), targets, views(spark, sf), EDGES, ["delay", "side"], chunk_width(spark, sf, "events"))


@query(
    "route_control_response",
    f"""{ROUTES},
    pool AS (SELECT u, u % 2 AS p, row_number() OVER (PARTITION BY u % 2 ORDER BY u) - 1 AS k, count(*) OVER (PARTITION BY u % 2) AS m
      FROM (SELECT DISTINCT u FROM ev) WHERE u NOT IN (SELECT trig FROM sel UNION SELECT recv FROM sel)),
    dr AS (SELECT event_id, trig, t, pool.u AS unit FROM tr JOIN pool ON pool.p <> trig % 2 AND k = {_hash_sql('event_id', str(SEED))} % m),
    {_seen_sql('a', 'SELECT event_id, trig, t, recv AS unit FROM tr')}, {_seen_sql('c', 'SELECT event_id, trig, t, unit FROM dr')},
    x AS (SELECT trig % 3 AS delay, b, sum(s)::BIGINT AS hits, count(*) AS triggers FROM a GROUP BY ALL),
    y AS (SELECT trig % 3 AS delay, b, sum(s)::BIGINT AS hits, count(*) AS triggers FROM c GROUP BY ALL)
    SELECT x.delay, x.b, x.hits, x.triggers, round(x.hits / x.triggers, 9) AS prob, y.hits AS control_hits, y.triggers AS control_triggers,
      round(y.hits / y.triggers, 9) AS control_prob FROM x JOIN y ON x.delay = y.delay AND x.b = y.b""",
)
def route_control_response(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the receivers, and of a unit of the other population that no pair selects, drawn afresh for every event."""
    sel = stage(pairs(spark, sf, edges(spark, sf)))
    taken = sel.select(F.explode(F.array("trigger", "receiver")).alias("unit")).distinct()
    units = events(spark, sf).select(F.col("u").alias("unit")).distinct().join(taken, "unit", "left_anti")
    pool = units.select((1 - F.col("unit") % 2).alias("side"), "unit")  # the side that draws it
    tr = stage(trigger_events(spark, sf, sel))
    drawn = routes.drawn_controls(tr, pool, "side", SEED, chunk_width(spark, sf, "events"))
    asks = tr.select(F.col("receiver").alias("unit"), "t", F.struct("delay", "event", F.lit(False).alias("control")).alias("ask"))
    others = drawn.select(F.col("control").alias("unit"), "t", F.struct("delay", "event", F.lit(True).alias("control")).alias("ask"))
    hits = routes.answered(asks.unionByName(others), views(spark, sf), EDGES, chunk_width(spark, sf, "events"))
    hits = hits.select("ask.delay", "ask.control", "b", "hit")
    real, control = (aligned.response_curve(hits.filter(F.col("control") == c), "hit", ["delay"]) for c in (False, True))
    names = ("hits", "triggers", "prob")
    control = control.select("delay", "b", *[F.col(c).alias(f"control_{c}") for c in names])
    both = stage(real).join(stage(control), ["delay", "b"])
    return both.select("delay", "b", "hits", "triggers", rounded("prob", 9).alias("prob"), "control_hits", "control_triggers", rounded("control_prob", 9).alias("control_prob"))

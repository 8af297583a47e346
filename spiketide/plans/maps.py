"""Queries: smoothed joint maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import gaussian_taps, rounded
from spiketide.operators import maps
from spiketide.plans.rates import EV, POP, pop_of
from spiketide.plans.registry import query
from spiketide.plans.tables import DAY, HOUR, events

TAPS = gaussian_taps(1.5, 4)
SHAPE = 96, 200  # quarter hours of the day, values in steps of 2
QUARTER = HOUR // 4
TAP_ROWS = ", ".join(f"({j - len(TAPS) // 2}, {w!r}::DOUBLE)" for j, w in enumerate(TAPS))


def _mirror_sql(at: str, size: int) -> str:
    return f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {size} THEN {2 * size - 1} - ({at}) ELSE {at} END"


@query(
    "joint_map_smooth",
    f"""WITH {EV}, c AS (SELECT {POP} AS pop, (t % {DAY}) // {QUARTER} AS r, CAST(floor(x / 2) AS BIGINT) AS c, count(*) AS n FROM ev WHERE x >= 0 AND x < {2 * SHAPE[1]} GROUP BY ALL),
    k(j, w) AS (VALUES {TAP_ROWS}),
    a AS (SELECT pop, r.r AS r, c.c AS c, sum(w * n) AS v FROM range(0, {SHAPE[0]}) r(r) CROSS JOIN k JOIN c ON c.r = {_mirror_sql('r.r + j', SHAPE[0])} GROUP BY ALL),
    b AS (SELECT pop, a.r, c.c AS c, sum(w * v) AS v FROM range(0, {SHAPE[1]}) c(c) CROSS JOIN k JOIN a ON a.c = {_mirror_sql('c.c + j', SHAPE[1])} GROUP BY ALL)
    SELECT pop, r AS "row", c AS col, round(v, 7) AS smooth FROM b""",
)
def joint_map_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of events by time of day and value, smoothed along both axes, on blocks of 32 x 32 cells."""
    ev = events(spark, sf).filter((F.col("x") >= 0) & (F.col("x") < 2 * SHAPE[1]))
    row = F.expr(f"(t % {DAY}) div {QUARTER}")
    counts = ev.groupBy(pop_of().alias("pop"), row.alias("r"), F.floor(F.col("x") / 2).alias("c")).agg(F.count("*").alias("n"))
    out = maps.smooth_map(counts, ["pop"], "r", "c", "n", SHAPE, TAPS, block=32)
    return out.select("pop", "row", "col", rounded("smooth", 7).alias("smooth"))

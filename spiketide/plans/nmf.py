"""Queries: non-negative parts of amplitude spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions import spectral
from spiketide.functions.columns import rounded
from spiketide.operators import nmf
from spiketide.operators.kmeans import PRIME
from spiketide.plans.clusters import points
from spiketide.plans.registry import query
from spiketide.plans.signals import DFT

PARTS, FEATURES = 4, 32
# fixed values: rounds of a start, and starts
ROUNDS, RESTARTS = 50, 5


def _unit_sql(pid: str, salt: str, step: int) -> str:
    x = f"(({pid} % {PRIME} * 48271 + ({salt}) * 40692 + {step} * 39373 + 1) % {PRIME})"
    for add in (7, 11):
        x = f"list_transform([{x}], lambda x: (x * x % {PRIME} + x * 16807 + {add}) % {PRIME})[1]"
    return f"(({x} + 1.0::DOUBLE) / ({PRIME} + 1.0::DOUBLE))"


def replayed(rounds: int, restarts: int) -> str:
    """Rows of W with the H of their restart beside them, round after round; ``fin`` is the last one, ``best`` the best restart."""
    js, fs = range(PARTS), range(1, FEATURES + 1)
    start_w = ", ".join(f"{_unit_sql('pid', f'{PARTS * 1000} + r.r', j)} AS w{j}" for j in js)
    start_h = ", ".join(
        f"array_value({', '.join(_unit_sql(f'{f - 1}::BIGINT', f'{PARTS * 1000 + 500_000} + r', j) for f in fs)}) AS h{j}" for j in js
    )
    ip = lambda a, b: f"array_inner_product({a}, {b})"
    new_w = ", ".join(f"w{j} * {ip('v', f'h{j}')} / ({' + '.join(f'w{m} * {ip(f'h{m}', f'h{j}')}' for m in js)} + {nmf.TINY}) AS w{j}" for j in js)
    hs, ws = ", ".join(f"h{j}" for j in js), ", ".join(f"w{j}" for j in js)
    step = f"SELECT it + 1 AS it, r, pid, v, {new_w}, {hs} FROM wh JOIN p USING (pid) WHERE it < {rounds}"
    sums = ", ".join([f"array_value({', '.join(f'sum(w{j} * v[{f}])' for f in fs)}) AS a{j}" for j in js] + [f"sum(w{j} * w{m}) AS g{j}{m}" for j in js for m in js])
    new_h = ", ".join(
        "array_value(" + ", ".join(f"h{j}[{f}] * a{j}[{f}] / ({' + '.join(f'g{j}{m} * h{m}[{f}]' for m in js)} + {nmf.TINY})" for f in fs) + f") AS h{j}" for j in js
    )
    cost = " + ".join(f"pow(v[{f}] - ({' + '.join(f'w{j} * h{j}[{f}]' for j in js)}), 2)" for f in fs)
    return f"""{DFT}, p AS MATERIALIZED (SELECT vec_id AS pid, list(amp ORDER BY k)::DOUBLE[{FEATURES}] AS v FROM a GROUP BY vec_id),
    h0 AS MATERIALIZED (SELECT r, {start_h} FROM range(0, {restarts}) r(r)),
    wh AS (
      SELECT 0 AS it, r.r AS r, pid, {start_w}, {hs} FROM p CROSS JOIN range(0, {restarts}) r(r) JOIN h0 ON h0.r = r.r
      UNION ALL
      SELECT x.it, x.r, x.pid, {ws}, {hs} FROM ({step.replace(f', {hs} FROM', ' FROM')}) x
      JOIN (SELECT r, {new_h} FROM (SELECT r, {sums}, {", ".join(f"any_value(h{j}) AS h{j}" for j in js)} FROM ({step}) GROUP BY r)) USING (r)),
    fin AS MATERIALIZED (SELECT * FROM wh WHERE it = {rounds}),
    err AS (SELECT r, sum({cost}) AS e FROM fin JOIN p USING (pid) GROUP BY r),
    best AS (SELECT arg_min(r, e) AS r FROM err),
    nrm AS MATERIALIZED (SELECT r, {", ".join(f"sqrt(sum(w{j} * w{j})) AS n{j}, any_value(h{j}) AS h{j}" for j in js)} FROM fin GROUP BY r)"""


def parts_sql(rounds: int, restarts: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT r, {j} AS part, unnest(range(0, {FEATURES})) AS feature, unnest(h{j}::DOUBLE[]) * n{j} AS w FROM nrm" for j in range(PARTS)
    )
    return f"""WITH RECURSIVE {replayed(rounds, restarts)}
    SELECT q.r AS restart, q.r = best.r AS best, round(e, 6) AS error, part::BIGINT AS part, feature, round(w, 6) AS weight FROM ({rows}) q JOIN err USING (r) CROSS JOIN best"""


def loadings_sql(rounds: int, restarts: int) -> str:
    rows = " UNION ALL ".join(f"SELECT pid, {j}::BIGINT AS part, w{j} / n{j} AS w FROM fin JOIN nrm USING (r) JOIN best USING (r)" for j in range(PARTS))
    return f"WITH RECURSIVE {replayed(rounds, restarts)} SELECT pid AS vec_id, part, round(w, 7) AS weight FROM ({rows})"


def factorised(spark: SparkSession, sf: str, rounds: int, restarts: int) -> tuple[nmf.Factorisation, nmf.Factors]:
    spectra = points(spark, sf).select("vec_id", spectral.amplitude("v").alias("a"))
    model = nmf.Factorisation(spectra, "vec_id", "a", FEATURES)
    return model, model.fit(PARTS, rounds, restarts)


@query("nmf_parts", parts_sql(ROUNDS, RESTARTS))
def nmf_parts(spark: SparkSession, sf: str, rounds: int = ROUNDS, restarts: int = RESTARTS) -> DataFrame:
    """Parts (H) of every restart after 50 rounds, its squared error, and which restart is best."""
    model, found = factorised(spark, sf, rounds, restarts)
    rows = [
        (r, r == found.best, e, j, f, float(w))
        for r, e in enumerate(found.errors)
        for j, part in enumerate(model.parts(found, r))
        for f, w in enumerate(part)
    ]
    out = spark.createDataFrame(rows, "restart long, best boolean, error double, part long, feature long, weight double")
    return out.withColumn("error", rounded("error")).withColumn("weight", rounded("weight"))


@query("nmf_loadings", loadings_sql(ROUNDS, RESTARTS))
def nmf_loadings(spark: SparkSession, sf: str, rounds: int = ROUNDS, restarts: int = RESTARTS) -> DataFrame:
    """Loadings (W) of every point on the parts of the best restart."""
    model, found = factorised(spark, sf, rounds, restarts)
    rows = model.loadings(found, found.best).select(F.col("pid").alias("vec_id"), F.posexplode("weights").alias("part", "w"))
    return rows.select("vec_id", F.col("part").cast("bigint").alias("part"), rounded("w", 7).alias("weight"))

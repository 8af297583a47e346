"""Queries: parameter grids, job ids, derived parameters, edge updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import decode_index, encode_index, rounded
from spiketide.operators import sweeps
from spiketide.plans.registry import query
from spiketide.plans.tables import table

AXES = ("l_returnflag", "l_linestatus", "l_linenumber")


@query(
    "param_sweep_cross",
    """WITH a AS (SELECT DISTINCT l_returnflag AS x FROM lineitem), b AS (SELECT DISTINCT l_linestatus AS y FROM lineitem),
    c AS (SELECT DISTINCT l_linenumber AS z FROM lineitem), g AS (SELECT x, y, CAST(z AS BIGINT) AS z FROM a, b, c)
    SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS job_id, x AS flag, y AS status, z AS line FROM g""",
)
def param_sweep_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Full grid of the values that occur; the job id is the row-major index."""
    src = table(spark, sf, "lineitem", *AXES)
    g = sweeps.expand_values(src, AXES)
    sizes = [src.agg(F.count_distinct(a)).scalar() for a in AXES]
    flat = encode_index([f"i_{a}" for a in AXES], sizes)
    return g.select(flat.alias("job_id"), F.col(AXES[0]).alias("flag"), F.col(AXES[1]).alias("status"), F.col(AXES[2]).cast("bigint").alias("line"))


@query(
    "index_encode_decode",
    """WITH c AS (SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) * 7
      + l_linenumber - 1 AS id FROM lineitem)
    SELECT CAST(id AS BIGINT) AS job_id, CAST(id // 14 AS BIGINT) AS i, CAST(id // 7 % 2 AS BIGINT) AS j, CAST(id % 7 AS BIGINT) AS k, count(*) AS n
    FROM c GROUP BY ALL""",
)
def index_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    i = F.when(F.col(AXES[0]) == "A", 0).when(F.col(AXES[0]) == "N", 1).otherwise(2)
    j = F.when(F.col(AXES[1]) == "F", 0).otherwise(1)
    flat = encode_index([i, j, F.col(AXES[2]) - 1], (3, 2, 7))
    n = table(spark, sf, "lineitem", *AXES).groupBy(flat.alias("job_id")).agg(F.count("*").alias("n"))
    return n.select("job_id", *[c.alias(a) for a, c in zip("ijk", decode_index("job_id", (3, 2, 7)))], "n")


@query(
    "sweep_parameters",
    """WITH s AS (SELECT round(l_discount * 100) / 10 AS rank, round(l_tax * 100) / 4 - 1 AS wx, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT round(rank, 6) AS rank, round(wx, 6) AS wx, n, round(CASE WHEN wx < 0 THEN 1 + wx ELSE 1 END, 6) AS w_slow,
    round(CASE WHEN wx > 0 THEN 1 - wx ELSE 1 END, 6) AS w_fast, round(0.051 * (1 - rank) + 0.234 * rank, 9) AS p,
    round(0.3 * sqrt(0.01) / sqrt(0.051 * (1 - rank) + 0.234 * rank), 9) AS w FROM s""",
)
def sweep_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Sweep coordinates to model parameters."""
    s = (
        table(spark, sf, "lineitem", "l_discount", "l_tax")
        .groupBy((F.round(F.col("l_discount") * 100) / 10).alias("rank"), (F.round(F.col("l_tax") * 100) / 4 - 1).alias("wx"))
        .agg(F.count("*").alias("n"))
    )
    slow, fast = sweeps.path_weights("wx")
    p = sweeps.between(0.051, 0.234, "rank")
    return s.select(
        rounded("rank").alias("rank"), rounded("wx").alias("wx"), "n", rounded(slow).alias("w_slow"), rounded(fast).alias("w_fast"),
        rounded(p, 9).alias("p"), rounded(sweeps.weight_for(0.3, p), 9).alias("w"),
    )


@query(
    "class_assignment",
    """WITH t AS (SELECT count(*) AS n FROM part) SELECT CASE WHEN p_partkey < round(n * 0.8) THEN 0 ELSE 1 END::BIGINT AS class,
    count(*) AS units, round(avg(p_retailprice), 6) AS m FROM part, t WHERE p_partkey < n GROUP BY 1""",
)
def class_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Units split 80/20 by consecutive ranges."""
    part = table(spark, sf, "part", "p_partkey", "p_retailprice")
    n = part.agg(F.count("*")).scalar()
    cls = sweeps.class_of("p_partkey", "n", (0.8, 0.2))
    return (
        part.withColumn("n", n).groupBy(cls.alias("class")).agg(F.count("*").alias("units"), rounded(F.avg("p_retailprice")).alias("m"))
    ).filter("class IS NOT NULL")


@query(
    "cell_ranges",
    """WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS type, count(*) AS n FROM customer GROUP BY 1)
    SELECT type, CAST(sum(n) OVER (ORDER BY type) - n AS BIGINT) AS "first", CAST(sum(n) OVER (ORDER BY type) AS BIGINT) AS "last" FROM s""",
)
def cell_ranges(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "customer", "c_nationkey").groupBy(F.col("c_nationkey").cast("bigint").alias("type")).agg(F.count("*").alias("n"))
    return sweeps.cell_ranges(sizes, "type", "n")


@query(
    "align_sweeps",
    """WITH g AS (SELECT l_returnflag AS f, CAST(l_linenumber AS BIGINT) AS line, CAST(round(l_discount / 0.02::DOUBLE) AS BIGINT) AS disc,
      sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT line, disc, round(a.s / a.n, 4) AS a, round(b.s / b.n, 4) AS b FROM g a JOIN g b USING (line, disc) WHERE a.f = 'A' AND b.f = 'R'""",
)
def align_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    """Two sweeps met by coordinates rounded to a coarser step."""
    step = 0.02
    g = (
        table(spark, sf, "lineitem", "l_returnflag", "l_linenumber", "l_discount", "l_extendedprice")
        .groupBy(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("line"), (F.round(F.col("l_discount") / step) * step).alias("disc"))
        .agg(F.avg("l_extendedprice").alias("v"))
    )
    out = sweeps.align(g.filter("f = 'A'"), g.filter("f = 'R'"), {"line": 1.0, "disc": step}, ("v", "v"))
    return out.select("line", "disc", rounded("a", 4).alias("a"), rounded("b", 4).alias("b"))


@query(
    "rewire_edges",
    """WITH e AS (SELECT l_suppkey AS pre, l_partkey AS post, count(*) AS w, min(l_linenumber)::BIGINT AS delay FROM lineitem GROUP BY 1, 2)
    SELECT pre, post, w, CASE WHEN s_acctbal < 0 AND w > 1 THEN 9 ELSE delay END::BIGINT AS delay FROM e JOIN supplier ON s_suppkey = pre
    WHERE post NOT IN (SELECT p_partkey FROM part WHERE p_size = 7)""",
)
def rewire_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Cut the inputs of some nodes and give chosen pairs a new delay."""
    e = (
        table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_linenumber")
        .groupBy(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"))
        .agg(F.count("*").alias("w"), F.min("l_linenumber").cast("bigint").alias("delay"))
    )
    cut = table(spark, sf, "part", "p_partkey", "p_size").filter("p_size = 7").select(F.col("p_partkey").alias("post"))
    weak = table(spark, sf, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("pre"))
    pairs = e.filter("w > 1").join(weak, "pre", "left_semi").select("pre", "post", F.lit(9).cast("bigint").alias("delay"))
    return sweeps.rewire(e, cut, pairs)


@query(
    "job_catalog",
    """SELECT o_orderkey AS job_id, o_orderpriority AS prio, n, round(q, 6) AS q FROM orders LEFT JOIN
    (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON l_orderkey = o_orderkey""",
)
def job_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every job with its result, NULL where there is none."""
    jobs = table(spark, sf, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("prio"))
    res = (
        table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity")
        .filter("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(F.count("*").alias("n"), rounded(F.avg("l_quantity")).alias("q"))
    )
    return sweeps.attach_results(jobs, res)

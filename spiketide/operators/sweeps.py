"""Parameter sweeps: grids, job ids, derived model parameters, edge updates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import as_col, decode_index


def expand(spark: SparkSession, axes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Jobs of a full grid: a distributed range whose ids are decoded into axis values."""
    sizes = [len(v) for v in axes.values()]
    idx = decode_index("job_id", sizes)
    values = [
        F.get(F.array(*[F.lit(x) for x in v]), i.cast("int")).alias(n) for (n, v), i in zip(axes.items(), idx)
    ]
    jobs = spark.range(math.prod(sizes)).withColumnRenamed("id", "job_id")
    return jobs.select("job_id", *[i.alias(f"i_{n}") for n, i in zip(axes, idx)], *values)


def expand_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Grid of all distinct values found in the columns, with their positions.

    Distinct values are merged before they meet, one short sorted list per axis.
    """
    lists = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])
    for c in cols:
        rest = [x for x in lists.columns if x != c]
        lists = lists.select(*rest, F.posexplode(c).alias(f"i_{c}", c))
    return lists


def attach_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Catalog of a run: every job, with NULL where its result is missing."""
    return jobs.join(results, "job_id", "left")


def path_weights(wx: Column | str) -> tuple[Column, Column]:
    """(slow, fast) weight of a signed asymmetry: positive weakens fast, negative weakens slow."""
    wx = as_col(wx)
    return F.lit(1.0) + F.least(wx, F.lit(0.0)), F.lit(1.0) - F.greatest(wx, F.lit(0.0))


def between(lo: float, hi: float, rank: Column | str) -> Column:
    """Linear interpolation; NULL when the rank leaves [0, 1]."""
    r = as_col(rank)
    return F.when((r >= 0) & (r <= 1), F.lit(lo) * (1 - r) + F.lit(hi) * r)


def weight_for(c: float, p: Column | str) -> Column:
    """Weight that keeps the input variance of a connection probability: c sqrt(0.01) / sqrt(p)."""
    return F.lit(c * 0.1) / F.sqrt(as_col(p))


def class_of(pos: Column | str, total: Column | str, shares: Sequence[float]) -> Column:
    """Class of a unit by its place in consecutive ranges with the given shares of all units."""
    pos, total = as_col(pos), as_col(total)
    expr, edge = F.lit(None).cast("bigint"), 1.0
    for k in range(len(shares) - 1, -1, -1):
        edge -= shares[k]
        hi = F.round(total * (edge + shares[k]))
        expr = F.when(pos < hi, F.lit(k).cast("bigint")).otherwise(expr)
    return F.when(pos >= 0, expr)


def cell_ranges(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """[first, last) of consecutive blocks from a table with one row per type."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return sizes.select(order, (F.sum(size).over(w) - F.col(size)).alias("first"), F.sum(size).over(w).alias("last"))


def unset_couplings(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Edges whose weight was never set (NULL, NaN or infinite): what has to be empty before a run."""
    w = F.col(weight).cast("double")
    return edges.filter(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))


def job_parameters(jobs: DataFrame, job_id: int) -> DataFrame:
    """(name, value) of one job of an expanded sweep."""
    names = [c for c in jobs.columns if c != "job_id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    return jobs.filter(F.col("job_id") == job_id).select(F.inline(pairs))


def mean_degrees(p: Column, n_pre: Column, n_post: Column) -> tuple[Column, Column]:
    """Mean (out, in) degree of a random connection of probability p."""
    return p * n_post, p * n_pre


def rewire(edges: DataFrame, cut_posts: DataFrame, delays: DataFrame) -> DataFrame:
    """Disconnect the inputs of chosen nodes and set the delay of chosen (pre, post) pairs."""
    kept = edges.join(cut_posts.select("post").distinct(), "post", "left_anti")
    new = delays.select("pre", "post", F.col("delay").alias("_d"))
    return kept.join(new, ["pre", "post"], "left").withColumn("delay", F.coalesce("_d", "delay")).drop("_d")


def align(a: DataFrame, b: DataFrame, axes: Mapping[str, float], values: tuple[str, str]) -> DataFrame:
    """Join two sweeps whose coordinates agree after rounding to the axis steps."""

    def keyed(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.select(*[F.round(F.col(c) / step).cast("bigint").alias(c) for c, step in axes.items()], F.col(value).alias(name))

    return keyed(a, values[0], "a").join(keyed(b, values[1], "b"), list(axes))

"""Graphs as edge tables: components, threshold clusters, random edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import rank_hash
from spiketide.session import stage


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, comp): the smallest node id reachable from a.  ``edges`` (a, b) hold both directions.

    Each round hooks every end point to its smallest neighbour, shortens the
    chains of hooks, and contracts the edge table to the ends that are left, so
    it shrinks from round to round and long paths need few rounds.
    """
    e = stage(edges.filter("a <> b").select("a", "b").distinct())
    out = nodes.select("a", F.col("a").alias("comp"))
    for _ in range(max_rounds):
        if e.isEmpty():
            return out
        hook = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        for _ in range(2):
            onward = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(onward, "p").select("a", F.col("q").alias("p"))
        hook = stage(hook)
        ends = e.join(hook.withColumnRenamed("p", "x"), "a").join(hook.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        e = stage(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        moved = hook.select(F.col("a").alias("comp"), "p")
        out = out.join(moved, "comp", "left").select("a", F.coalesce("p", "comp").alias("comp"))
    raise RuntimeError("components did not settle")


def threshold_clusters(matrix: DataFrame, level: float) -> DataFrame:
    """Cut of a single-linkage tree: points linked by a chain of similarities >= level.

    ``matrix`` is a consensus table (i, j, c); returns (sig, cluster) with clusters
    named by their smallest member.
    """
    m = stage(matrix.select("i", "j", "c"))
    nodes = m.filter("i = j").select(F.col("i").alias("a"))
    far = m.filter((F.col("i") != F.col("j")) & (F.col("c") >= level))
    pairs = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    return components(nodes, far.select(F.inline(pairs))).select(F.col("a").alias("sig"), F.col("comp").alias("cluster"))


def random_edges(posts: DataFrame, pres: DataFrame, degree: int, seed: int) -> DataFrame:
    """``degree`` distinct sources, drawn by hash from the keys of ``pres`` (pre), for every row of ``posts`` (post): (pre, post).

    A node draws with repetition, keeps the first occurrences and never links
    to itself.  Nodes that have drawn too few draw on, four times as often in
    every round, until they have ``degree`` sources or all there are.  Sources
    are numbered inside ranges of their keys, so no task sees all of them.
    """
    pres = pres.select("pre").distinct()
    numbered, n = dense_rank(pres, "pre")
    numbered = stage(numbered)
    if not n:
        return posts.select(F.col("post").alias("pre"), "post").limit(0)
    own = pres.select(F.col("pre").alias("post"), F.lit(1).alias("_own"))
    open_ = stage(posts.select("post").distinct().join(own, "post", "left").select("post", F.least(F.lit(degree), n - F.coalesce("_own", F.lit(0))).alias("_want")))
    kept, draws = [], 8 * degree
    while True:
        drawn = open_.select("post", "_want", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_j")).withColumn("_seed", F.lit(seed))
        index = F.pmod(rank_hash("post", "_j", "_seed"), F.lit(n).cast("bigint"))
        first = drawn.withColumn("_i", index).groupBy("post", "_want", "_i").agg(F.min("_j").alias("_j"))
        found = first.join(numbered, "_i").filter("pre <> post")
        top = F.slice(F.array_sort(F.collect_list(F.struct("_j", "pre"))), F.lit(1), F.col("_want"))  # as many as draws at most
        listed = stage(found.groupBy("post", "_want").agg(top.alias("_d")))
        done = listed.filter(F.size("_d") >= F.col("_want"))
        kept.append(done.select(F.explode("_d.pre").alias("pre"), "post"))
        open_ = stage(open_.filter("_want > 0").join(done, "post", "left_anti"))
        if open_.isEmpty():
            break
        draws *= 4
    edges = reduce(DataFrame.union, kept)
    return posts.join(edges, "post").select("pre", "post")


def dense_rank(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(_i, key): distinct keys numbered 0, 1, 2 ... in their order, and how many there are."""
    spread = stage(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = stage(sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), "_n"))
    total = before.agg(F.sum("_n").alias("n")).first()["n"] or 0
    place = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return spread.join(before, "_part").select((F.col("_before") + place).alias("_i"), key), int(total)

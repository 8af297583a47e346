"""Merkle manifest of a table by nested intervals.

A leaf is the digest of one row.  Leaves have ranks inside their group; a node
covers an interval of ranks and is the digest of up to FANOUT nodes below it.
The interval is the node's label: the ancestor of a row at some level is the
node of that level that contains its rank, found in the bucket of the rank, and
the siblings at that level are the parent's interval without the child's.
The tops of the groups, in the order of the groups, are the leaves of one more
tree, whose top is the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.session import stage

FANOUT = 16
NULL_GROUP = ""  # group keys are "" for null and "=" before the value, so null comes first
PATH = "array<struct<left:string,right:string>>"


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = col.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def group_key(col: Column) -> Column:
    value = col.cast("string")
    return F.when(value.isNull(), F.lit(NULL_GROUP)).otherwise(F.concat(F.lit("="), value))


def label(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves with ``lo``, ``hi`` (their rank in the group, and one more) and ``total`` (leaves of the group).

    Rows are dealt by ranges of (group, order), so a group of any size spans as
    many tasks as it needs; equal rows are told apart by where they were read.
    Ranks follow from the row's place in its range and one count for each
    (range, group).
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", *order, "row"]
    dealt = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stage(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).drop("row"))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = W.partitionBy("g")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = stage(counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(whole).alias("total")))
    ranked = placed.join(base, ["g", "part"]).withColumn("lo", F.col("at") + F.col("base"))
    return ranked.withColumn("hi", F.col("lo") + 1).drop("at", "part", "base")


def _nodes_at(level: int) -> Column:
    """Nodes of the row's group at a level."""
    return F.expr(f"(total + {FANOUT**level - 1}L) div {FANOUT**level}L")


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FANOUT**level}L")


class Tree(NamedTuple):
    """``levels[0]`` are the labelled leaves; above, nodes with ``kids`` (intervals and digests of the nodes below)."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """``g``, ``digest``: the node of each group that has none beside it on its level."""
        found = [t.filter(_nodes_at(k) == 1).select("g", "digest") for k, t in enumerate(self.levels)]
        return reduce(DataFrame.union, found)


def build(leaves: DataFrame) -> Tree:
    """Levels of the trees of all groups: rows ``g, lo, hi, total, digest`` upwards from labelled leaves."""
    levels = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    level = 0
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        below = levels[-1].filter(_nodes_at(level - 1) > 1)
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        nodes = below.groupBy("g", "total", _bucket(level).alias("bucket")).agg(kids.alias("kids"))
        nodes = nodes.select(
            "g",
            F.col("kids")[0]["lo"].alias("lo"),
            F.element_at("kids", -1)["hi"].alias("hi"),
            "total",
            F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"),
            "kids",
        )
        levels.append(stage(nodes))
    return Tree(levels)


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Leaves with ``path``: for each level upwards the joined digests of the siblings to the left and to the right.

    ``above`` has ``g``, the path from the top of the group (``up``) and
    columns that every leaf of the group gets.  The way is from the tops down:
    each level takes its ancestors' path by one containment join on the bucket
    of the level above, so a path is attached to sixteen nodes at a time.
    """
    given = [c for c in above.columns if c not in ("g", "up")]
    found: DataFrame | None = None
    for level in range(len(tree.levels) - 1, -1, -1):
        rows = tree.levels[level]
        here = rows.filter(_nodes_at(level) == 1).join(above, "g").withColumnRenamed("up", "path")
        if found is not None:
            parents = found.select(
                F.col("g").alias("pg"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("kids").alias("pkids"), F.col("path").alias("up"), *given, _bucket(level + 1).alias("pbucket")
            )
            inside = (F.col("g") == F.col("pg")) & (F.col("bucket") == F.col("pbucket")) & (F.col("plo") <= F.col("lo")) & (F.col("hi") <= F.col("phi"))
            child = rows.filter(_nodes_at(level) > 1).withColumn("bucket", _bucket(level + 1)).join(parents, inside)
            left = F.array_join(F.transform(F.filter("pkids", lambda k: k["hi"] <= F.col("lo")), lambda k: k["digest"]), "")
            right = F.array_join(F.transform(F.filter("pkids", lambda k: k["lo"] >= F.col("hi")), lambda k: k["digest"]), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            child = child.withColumn("path", F.concat(step, "up")).select(*rows.columns, *given, "path")
            here = child.unionByName(here.select(*rows.columns, *given, "path"))
        found = here
    return found


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest's entry of every row.

    Rows: ``id``, ``leaf`` (digest of ``fields``), ``subroot`` of its group,
    ``root``, ``path`` (for each level from the leaf to the root the siblings to
    the left and right, joined), and ``changed`` (digest of the row with the
    columns of ``changed`` in place of its own).

    Nulls of any field are written as ``-``; null groups are one group, the
    first; null ids come first.  Repeated ids are ordered by their digests;
    equal rows have equal digests, so their order does not matter.  Empty texts
    are values of no bytes.  An empty table gives no rows.  Only the named
    columns are read, under names of our own, so other columns never clash.
    """
    own = {c: F.col(c) for c in fields}
    leaves = docs.select(
        F.col(id_col).alias("id"),
        group_key(F.col(group_col)).alias("g"),
        leaf_digest(*own.values()).alias("digest"),
        leaf_digest(*(own | (changed or {})).values()).alias("changed"),
    )
    rows = stage(label(stage(leaves), ["id", "digest"]))
    trees = build(rows)
    tops = trees.tops().select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    groups = stage(label(stage(tops), ["name"]))
    over = build(groups)
    root = over.tops().select("g", F.col("digest").alias("root"), F.array().cast(PATH).alias("up"))
    named = paths(over, root).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", F.col("path").alias("up"))
    return paths(trees, stage(named)).select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", "changed")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    each = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(each, ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))

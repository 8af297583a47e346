"""Cluster quality, agreement over runs, grids of labels, feature summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.operators.graphs import components
from spiketide.operators.ordered import Track, ordinal
from spiketide.session import stage


TILE = 512  # points of a block that meet another block at a time


def silhouette(points: DataFrame, pid: str, label: str, vec: str, block: int = 4096) -> DataFrame:
    """Euclidean silhouette per point: (pid, label, a, b, s).

    The measure needs all distances, but no pair is ever a row: points are
    hashed into blocks, each task gets two blocks, and what leaves it is one
    value for each (block, other label), the sums of all points of the block
    side by side.  A task holds two blocks however large a cluster is.
    """
    src = points.select(F.col(pid).alias("pid"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    blocks = max(1, -(-src.count() // block))
    own_block = F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int")
    place = (F.row_number().over(W.partitionBy("b").orderBy("pid")) - 1).cast("int")  # a block of bounded size
    src = stage(src.withColumn("b", own_block).withColumn("k", place))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = src.withColumn("o", other).select("label", "vec", "b", "k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    kind = dict(src.dtypes)["label"]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = [pdf[pdf["b"] == n].sort_values("k") for n in dict.fromkeys((i, j))]
        rows: list[tuple] = []
        if all(len(side) for side in sides):
            me, them = sides[0], sides[-1]
            for mine, theirs in [(me, them)] if i == j else [(me, them), (them, me)]:
                x, y = (np.stack(side["vec"].to_numpy()).astype(float) for side in (mine, theirs))
                kinds, inv = np.unique(theirs["label"].to_numpy(), return_inverse=True)
                hot = np.zeros((len(inv), len(kinds)))
                hot[np.arange(len(inv)), inv] = 1.0
                square, out = (y * y).sum(1), np.empty((len(x), len(kinds)))
                for low in range(0, len(x), TILE):
                    part = x[low : low + TILE]
                    d2 = (part * part).sum(1)[:, None] + square[None, :] - 2 * part @ y.T
                    if i == j:
                        at = np.arange(len(part))
                        d2[at, at + low] = 0.0
                    out[low : low + TILE] = np.sqrt(np.maximum(d2, 0.0)) @ hot
                rows += [(int(mine["b"].iloc[0]), k, np.ascontiguousarray(out[:, c]).tobytes()) for c, k in enumerate(kinds)]
        return pd.DataFrame(rows, columns=["b", "other", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
        return pd.DataFrame({"b": pdf["b"].iloc[0], "k": np.arange(len(total)), "other": pdf["other"].iloc[0], "d": total})

    parts = spread.groupBy("i", "j").applyInPandas(sums, f"b int, other {kind}, sums binary")
    whole = parts.groupBy("b", "other").applyInPandas(added, f"b int, k int, other {kind}, d double")
    size = stage(src.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n")))
    own = F.col("label") == F.col("other")
    mean = F.try_divide(F.col("d"), F.when(own, F.col("n") - 1).otherwise(F.col("n")))
    per = whole.join(src.select("b", "k", "pid", "label"), ["b", "k"]).join(size, "other").select("b", "k", "pid", "label", "other", mean.alias("m"))
    ab = per.groupBy("b", "k", "pid", "label").agg(
        F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b_")
    )
    s = F.coalesce(F.try_divide(F.col("b_") - F.col("a"), F.greatest("a", "b_")), F.lit(0.0))
    return ab.select(F.col("pid").alias(pid), F.col("label").alias(label), "a", F.col("b_").alias("b"), s.alias("s"))


def signatures(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Points with the same label in every run, counted once: (sig, labels, n)."""
    sig = F.concat_ws("|", *[F.col(c).cast("string") for c in labels])
    return df.groupBy(*labels).agg(F.count("*").alias("n")).select(sig.alias("sig"), *labels, "n")


def consensus(df: DataFrame, labels: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted share of runs in which two points share a cluster, as (i, j, c, n_i, n_j) with i <= j.

    Points with equal labels in all runs are interchangeable, so the matrix is
    kept over those signatures; pairs that never meet are left out (c = 0).
    """
    weights = list(weights or [1.0] * len(labels))
    sig = stage(signatures(df, labels))
    runs = F.array(
        *[F.struct(F.lit(i).alias("run"), F.col(c).cast("string").alias("label"), F.lit(float(w)).alias("w")) for i, (c, w) in enumerate(zip(labels, weights))]
    )
    long = sig.select("sig", "n", F.inline(runs))
    a = long.select(F.col("sig").alias("i"), F.col("n").alias("n_i"), "run", "label", "w")
    b = long.select(F.col("sig").alias("j"), F.col("n").alias("n_j"), "run", "label")
    return (
        a.join(b, ["run", "label"])
        .filter("i <= j")
        .groupBy("i", "j", "n_i", "n_j")
        .agg((F.sum("w") / F.lit(sum(weights))).alias("c"))
    )


def ambiguous_share(matrix: DataFrame, points: Column, lo: float = 0.15, hi: float = 0.85, width: float = 0.05) -> DataFrame:
    """Proportion of ambiguous clustering: CDF(hi) - CDF(lo) over all point pairs, from bins of ``width``.

    Pairs that never share a cluster enter by subtraction.
    """
    same = F.col("i") == F.col("j")
    pairs = F.when(same, F.col("n_i") * (F.col("n_i") - 1) / 2).otherwise(F.col("n_i") * F.col("n_j"))
    b = F.round(F.col("c") / width).cast("bigint")
    hist = matrix.groupBy(b.alias("b")).agg(F.sum(pairs).alias("k"))
    inside = F.sum(F.when((F.col("b") > round(lo / width)) & (F.col("b") <= round(hi / width)), F.col("k")).otherwise(F.lit(0.0)))
    total = points * (points - 1) / 2
    return hist.agg(inside.alias("inside"), F.sum("k").alias("meeting")).select(
        (F.col("inside") / total).alias("pac"), (1 - F.col("meeting") / total).alias("never")
    )


def representatives(scored: DataFrame, label: str, pid: str, vec: str, dims: int, share: float = 0.25) -> DataFrame:
    """Member nearest to the weighted centre of the best-scored share of each label."""
    steps = 1 << 40
    pos = F.floor((1 - F.col("s")) * steps / 2).cast("bigint")
    ranked = ordinal(scored.withColumn("_pos", pos), Track((label,), "_pos", steps // 4096, tie=(pid,)), "rank")
    size = scored.groupBy(label).agg(F.floor(F.count("*") * share).alias("take"))
    w = F.greatest(F.col("s"), F.lit(0.0))
    centre = ranked.join(size, label).filter("rank < take").groupBy(label).agg(
        F.array(*[F.try_divide(F.sum(w * F.get(vec, F.lit(i))), F.sum(w)) for i in range(dims)]).alias("_c")
    )
    gap = F.sqrt(F.aggregate(F.zip_with(vec, "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return (
        scored.join(stage(centre), label)
        .withColumn("gap", gap)
        .groupBy(label)
        .agg(F.min(F.struct("gap", pid)).alias("m"))
        .select(label, F.col(f"m.{pid}").alias(pid), "m.gap")
    )


def silhouette_order(scored: DataFrame, label: str, pid: str) -> DataFrame:
    """(pid, label, pos, boundary): place of each point ordered by label and falling score ``s``.

    Ranks inside a label are counted in score chunks, labels are placed by the
    running sum of their sizes (one row per label).
    """
    steps = 1 << 40
    at = F.floor((1 - F.col("s")) * steps / 2).cast("bigint")
    down = scored.withColumn("_pos", at).withColumn("_neg", -F.col("s"))
    ranked = ordinal(down, Track((label,), "_pos", steps // 4096, tie=("_neg", pid)), "_rank")
    size = scored.groupBy(label).agg(F.count("*").alias("_n"))
    before = size.select(label, (F.sum("_n").over(W.orderBy(label).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_at"))
    return ranked.join(stage(before), label).select(
        pid, label, (F.col("_at") + F.col("_rank")).alias("pos"), (F.col("_rank") == 0).alias("boundary")
    )


def picks(df: DataFrame, label: str, pid: str, score: str, k: int) -> DataFrame:
    """The k lowest, k middle and k highest scores per label.

    The two ends are per-task top-k; the middle ranks come from a chunked
    count over evenly cut score positions.
    """
    steps = 1 << 40
    lo_hi = df.groupBy().agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    pos = F.floor((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * steps).cast("bigint")
    placed = df.withColumn("_lo", lo_hi.select("_lo").scalar()).withColumn("_hi", lo_hi.select("_hi").scalar())
    ranked = ordinal(placed.select(label, pid, score, pos.alias("_pos")), Track((label,), "_pos", steps // 4096, tie=(score, pid)), "r")
    size = df.groupBy(label).agg(F.count("*").alias("n"))
    r, half = F.col("r"), F.floor(F.col("n") / 2) - k // 2
    pick = (
        F.when(r < k, "worst").when(r >= F.col("n") - k, "best").when((r >= half) & (r < half + k), "mid")
    )
    return ranked.join(size, label).select(label, pid, pick.alias("pick")).filter("pick IS NOT NULL")


STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def grid_neighbours(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each cell beside its up to four neighbours: columns of the cell and n_<column> of the neighbour."""
    to = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in STEPS])
    other = [c for c in cells.columns if c not in ("r", "c", *keys)]
    sent = cells.select(*keys, F.explode(to).alias("_t"), F.col("r").alias("n_r"), F.col("c").alias("n_c"), *[F.col(c).alias(f"n_{c}") for c in other])
    sent = sent.select(*keys, F.col("_t.r").alias("r"), F.col("_t.c").alias("c"), "n_r", "n_c", *[f"n_{c}" for c in other])
    return cells.join(sent, [*keys, "r", "c"])


def grid_boundary(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Line pieces (x0, x1, y0, y1) between neighbouring cells of different state."""
    e = grid_neighbours(cells, keys).filter("state <> n_state")
    up = F.col("n_r") != F.col("r")
    mr, mc = (F.col("r") + F.col("n_r")) / 2, (F.col("c") + F.col("n_c")) / 2
    return e.select(
        *keys,
        F.when(up, F.col("c") - 0.5).otherwise(mc).alias("x0"),
        F.when(up, F.col("c") + 0.5).otherwise(mc).alias("x1"),
        F.when(up, mr).otherwise(F.col("r") - 0.5).alias("y0"),
        F.when(up, mr).otherwise(F.col("r") + 0.5).alias("y1"),
    )


def grid_components(cells: DataFrame, cols: int) -> DataFrame:
    """Connected cells of equal state; ``comp`` is the smallest r * cols + c inside."""
    key = (F.col("r") * cols + F.col("c")).cast("bigint")
    edges = grid_neighbours(cells).filter("state = n_state").select(
        key.alias("a"), (F.col("n_r") * cols + F.col("n_c")).cast("bigint").alias("b")
    )
    return cells.withColumn("a", key).join(components(cells.select(key.alias("a")), edges), "a").drop("a")


def majority_denoise(cells: DataFrame, weight: str | None = None) -> DataFrame:
    """Give a cell that agrees with no neighbour the state most of them have.

    One synchronous pass; with ``weight`` the summed positive weights decide
    first.  Ties go to more votes, then to the smaller state.
    """
    w = F.greatest(F.col(f"n_{weight}"), F.lit(0.0)) if weight else F.lit(1.0)
    near = grid_neighbours(cells)
    votes = near.groupBy("r", "c", "state", "n_state").agg(F.sum(w).alias("w"), F.count("*").alias("k"))
    best = votes.groupBy("r", "c", "state").agg(
        F.max(F.struct("w", "k", (-F.col("n_state")).alias("m"))).alias("top"),
        F.bool_or(F.col("state") == F.col("n_state")).alias("agrees"),
    )
    new = best.select("r", "c", F.when(F.col("agrees"), F.col("state")).otherwise(-F.col("top.m")).alias("_new"))
    return cells.join(new, ["r", "c"], "left").withColumn("state", F.coalesce("_new", "state")).drop("_new")


def drop_islands(cells: DataFrame, cols: int, smallest: int) -> DataFrame:
    """Recolour components below ``smallest`` cells with the commonest state around them."""
    comp = stage(grid_components(cells, cols))
    small = comp.groupBy("comp").agg(F.count("*").alias("k")).filter(F.col("k") < smallest).select("comp")
    votes = grid_neighbours(comp).filter("state <> n_state").join(small, "comp").groupBy("comp", "n_state").agg(F.count("*").alias("k"))
    new = votes.groupBy("comp").agg((-F.max(F.struct("k", (-F.col("n_state")).alias("m")))["m"]).alias("_new"))
    return comp.join(new, "comp", "left").withColumn("state", F.coalesce("_new", "state")).drop("_new", "comp")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long matrix (i, j, r) of all column pairs in one pass."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.agg(*[F.corr(cols[i], cols[j]).alias(f"_{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(F.lit(a).cast("bigint").alias("i"), F.lit(b).cast("bigint").alias("j"), F.col(f"_{min(a, b)}_{max(a, b)}").alias("r"))
        for a in range(len(cols))
        for b in range(len(cols))
    ]
    return wide.select(F.inline(F.array(*cells)))


def _square(matrix: DataFrame) -> np.ndarray:
    """The d x d matrix on the driver; d is the number of features, not of rows."""
    rows = matrix.collect()
    d = max(r["i"] for r in rows) + 1
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r["r"]
    return m


def principal_axes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(axis, share, cumulative, loadings) of the correlation matrix, strongest axis first."""
    vals, vecs = np.linalg.eigh(_square(correlation_matrix(df, cols)))
    order = np.argsort(vals)[::-1]
    share = vals[order] / vals.sum()
    rows = []
    for k, o in enumerate(order):
        v = vecs[:, o] * (1 if vecs[np.argmax(np.abs(vecs[:, o])), o] >= 0 else -1)
        rows.append((k, float(share[k]), float(share[: k + 1].sum()), [float(x) for x in v]))
    return df.sparkSession.createDataFrame(rows, "axis bigint, share double, cumulative double, loadings array<double>")


def uncorrelated_features(df: DataFrame, cols: Sequence[str], limit: float) -> list[str]:
    """Features kept when each must stay below ``limit`` with all kept before it."""
    m = np.abs(_square(correlation_matrix(df, cols)))
    kept: list[int] = []
    for i in range(len(cols)):
        if all(m[i, k] < limit for k in kept):
            kept.append(i)
    return [cols[i] for i in kept]


def kmeans_runs(df: DataFrame, vec: str, ks: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """Inertia and squared-distance silhouette per (k, seed).  The fits themselves are distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features")).persist()
    try:
        rows = []
        for k in ks:
            for seed in seeds:
                model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
                rows.append((k, seed, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(data)))))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k bigint, seed bigint, inertia double, silhouette double")


def nonnegative_factors(df: DataFrame, pid: str, vec: str, rank: int, rounds: int = 5, seed: int = 42) -> DataFrame:
    """Non-negative factorisation of a points x features table: (feature, part, weight)."""
    from pyspark.ml.recommendation import ALS

    long = df.select(F.col(pid).cast("int").alias("row"), F.posexplode(vec).alias("col", "v")).select("row", "col", F.col("v").cast("float").alias("v"))
    als = ALS(rank=rank, maxIter=rounds, regParam=0.01, nonnegative=True, userCol="row", itemCol="col", ratingCol="v", seed=seed)
    f = als.fit(long).itemFactors
    return f.select(F.col("id").cast("bigint").alias("feature"), F.posexplode("features").alias("part", "weight")).select(
        "feature", F.col("part").cast("bigint").alias("part"), F.col("weight").cast("double").alias("weight")
    )


def relabel_by_first(df: DataFrame, label: str, pos: str, start: int = 1) -> DataFrame:
    """New ids in order of first appearance: (label, new); one row per label is ordered."""
    first = df.groupBy(label).agg(F.min(pos).alias("_p"))
    return first.select(label, (F.row_number().over(W.orderBy("_p")) + (start - 1)).cast("bigint").alias("new"))

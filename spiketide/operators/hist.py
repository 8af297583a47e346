"""Histograms, contingency tables and agreement of two labelings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import ln_factorial


def histogram(df: DataFrame, bins: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Count rows per cell; a row outside any axis (NULL bin) is dropped."""
    names = list(bins)
    cells = df.select(*by, *[c.alias(n) for n, c in bins.items()]).dropna(subset=names)
    return cells.groupBy(*by, *names).agg(F.count("*").alias("n"))


def outer_counts(x: DataFrame, y: DataFrame) -> DataFrame:
    """Counts of all pairs (every x value with every y value) from the two marginals.

    Each side has one row per bin, so the y histogram fits one array.
    """
    other = y.agg(F.collect_list(F.struct(F.col("b").alias("y"), F.col("n").alias("ny")))).scalar()
    return x.select(F.col("b").alias("x"), F.col("n").alias("nx"), F.explode(other).alias("o")).select(
        "x", "o.y", (F.col("nx") * F.col("o.ny")).alias("n")
    )


def contingency(df: DataFrame, a: str, b: str, gate: Column | None = None) -> DataFrame:
    """(a, b, n, share of the row); ``gate`` keeps rows where it holds."""
    kept = df if gate is None else df.filter(gate)
    n = kept.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(a)))


def _margins(table: DataFrame, a: str, b: str) -> DataFrame:
    return table.select(
        F.col("n").cast("double").alias("n"),
        F.sum("n").over(W.partitionBy(a)).cast("double").alias("na"),
        F.sum("n").over(W.partitionBy(b)).cast("double").alias("nb"),
        F.row_number().over(W.partitionBy(a).orderBy(b)).alias("ka"),
        F.row_number().over(W.partitionBy(b).orderBy(a)).alias("kb"),
    )


def adjusted_rand(table: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from contingency counts ``n``."""

    def two(c: str) -> Column:
        return F.col(c) * (F.col(c) - 1) / 2

    s = _margins(table, a, b).agg(
        F.sum(two("n")).alias("ij"),
        F.sum(F.when(F.col("ka") == 1, two("na"))).alias("i"),
        F.sum(F.when(F.col("kb") == 1, two("nb"))).alias("j"),
        F.sum("n").alias("all"),
    )
    expected = F.try_divide(F.col("i") * F.col("j"), two("all"))
    return s.select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def adjusted_mutual_info(table: DataFrame, a: str, b: str, slice_len: int = 65536) -> DataFrame:
    """Adjusted mutual information, arithmetic normalisation, natural logs.

    The expected value under random labelings runs over the possible cell counts
    of every pair of labels.  A count is hypergeometric; beyond twelve deviations and
    forty from its mean its probability is zero in double precision, so only
    those in between are generated, in slices of at most ``slice_len`` that are dealt out again.
    """
    n = table.select(a, b, "n", F.sum("n").over(W.partitionBy(F.lit(1))).alias("all"))  # one row per cell
    rows = n.groupBy(a).agg(F.sum("n").alias("na"), F.max("all").alias("all"))
    cols = n.groupBy(b).agg(F.sum("n").alias("nb"))
    m = _margins(table, a, b).withColumn("all", F.sum("n").over(W.partitionBy(F.lit(1))))
    p = F.col("n") / F.col("all")
    seen = m.agg(
        F.sum(p * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(F.when(F.col("ka") == 1, -F.col("na") / F.col("all") * F.ln(F.col("na") / F.col("all")))).alias("ha"),
        F.sum(F.when(F.col("kb") == 1, -F.col("nb") / F.col("all") * F.ln(F.col("nb") / F.col("all")))).alias("hb"),
    )
    other = cols.agg(F.collect_list("nb")).scalar()  # one entry per label
    pair = rows.select("na", "all", F.explode(other).alias("nb"))
    x, y, t = (F.col(c).cast("double") for c in ("na", "nb", "all"))
    mid = x * y / t
    reach = 12 * F.sqrt(mid * (1 - x / t) * (1 - y / t) * t / F.greatest(t - 1, F.lit(1.0))) + 40
    lo = F.greatest(F.lit(1).cast("bigint"), F.col("na") + F.col("nb") - F.col("all"), F.floor(mid - reach))
    hi = F.least(F.col("na"), F.col("nb"), F.ceil(mid + reach))
    tasks = pair.sparkSession.sparkContext.defaultParallelism
    cell = (
        pair.select("*", lo.alias("_lo"), hi.alias("_hi")).filter("_lo <= _hi")
        .withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(slice_len).cast("bigint"))))
        .repartition(tasks, "na", "nb", "_from")
        .withColumn("k", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + slice_len - 1, F.col("_hi")))))
    )
    f = ln_factorial
    ln_p = (
        f("na") + f("nb") + f(F.col("all") - F.col("na")) + f(F.col("all") - F.col("nb"))
        - f("all") - f("k") - f(F.col("na") - F.col("k")) - f(F.col("nb") - F.col("k"))
        - f(F.col("all") - F.col("na") - F.col("nb") + F.col("k"))
    )
    k = F.col("k").cast("double")
    term = k / F.col("all") * F.ln(k * F.col("all") / (F.col("na").cast("double") * F.col("nb"))) * F.exp(ln_p)
    emi = cell.agg(F.sum(term)).scalar()
    return seen.withColumn("emi", emi).select(
        "mi", "emi", F.try_divide(F.col("mi") - F.col("emi"), (F.col("ha") + F.col("hb")) / 2 - F.col("emi")).alias("ami")
    )


def diagonal_sums(table: DataFrame, i: str, j: str, bins: int) -> DataFrame:
    """Mean of a bins x bins joint table along each diagonal i - j, times bins; empty cells are zeros."""
    d = F.col(i) - F.col(j)
    return table.groupBy(d.alias("lag")).agg((F.sum("n") / (F.lit(bins) - F.abs(F.first(d))) * bins).alias("v"))

"""Rates, interval statistics and synchrony of spike trains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spiketide.functions.columns import zero_filled_moments
from spiketide.operators.ordered import Track, neighbours, running


def firing_rate(counts: DataFrame, pop: str, units: Column, duration: Column | float) -> DataFrame:
    """Mean and population deviation of count/duration over all units of a population.

    ``counts`` has one row per (pop, unit) with column ``c``; units without an
    event need no row, ``units`` says how many there are.
    """
    avg, var = zero_filled_moments(F.count("*"), F.avg("c"), F.var_pop("c"), units)
    return counts.groupBy(pop).agg((avg / duration).alias("frs_m"), (F.sqrt(var) / duration).alias("frs_s"))


def interval_cv(df: DataFrame, track: Track, time: str) -> DataFrame:
    """Per key: number of events, CV of the true inter-event intervals (NULL below 3 events)."""
    d = F.col(time) - F.col(f"prev_{time}")
    return (
        neighbours(df, track, prev=[time])
        .groupBy(*track.keys)
        .agg(F.count("*").alias("events"), F.avg(d).alias("_m"), F.stddev_pop(d).alias("_s"))
        .select(*track.keys, "events", F.when(F.col("events") >= 3, F.try_divide("_s", "_m")).alias("cv"))
    )


def interval_cv_compat(df: DataFrame, track: Track, step: str) -> DataFrame:
    """The older convention: an interval from step -1 to the first event counts too."""
    d = (F.col(step) - F.coalesce(F.col(f"prev_{step}"), F.lit(-1))).cast("double")
    var = F.col("_q") - F.col("_m") * F.col("_m")
    return (
        neighbours(df, track, prev=[step])
        .groupBy(*track.keys)
        .agg(F.count("*").alias("events"), F.avg(d).alias("_m"), F.avg(d * d).alias("_q"))
        .select(
            *track.keys,
            "events",
            F.when(F.col("events") >= 3, F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), F.col("_m"))).alias("cv"),
        )
    )


def chi_synchrony(counts: DataFrame, pop: str, unit: str, time: str, bins: Column | int) -> DataFrame:
    """sqrt(Var(mean signal) * units / sum of unit variances) per population.

    ``counts`` holds the non-zero samples ``c`` of (pop, unit, time); the zeros
    enter through the moments, so no unit x time grid is built.
    """
    n = bins if isinstance(bins, Column) else F.lit(bins)
    _, unit_var = zero_filled_moments(F.count("*"), F.avg("c"), F.var_pop("c"), n)
    per_unit = counts.groupBy(pop, unit).agg(unit_var.alias("v"))
    spread = per_unit.groupBy(pop).agg(F.sum("v").alias("unit_var"), F.count("*").alias("units"))
    _, sum_var = zero_filled_moments(F.count("*"), F.avg("s"), F.var_pop("s"), n)
    common = counts.groupBy(pop, time).agg(F.sum("c").cast("double").alias("s")).groupBy(pop).agg(sum_var.alias("sum_var"))
    # Var(s / units) * units = Var(s) / units
    return spread.join(common, pop).select(
        pop, "units", F.sqrt(F.try_divide(F.col("sum_var"), F.col("units") * F.col("unit_var"))).alias("chi")
    )


def pair_synchrony(presence: DataFrame, pop: str, unit: str, time: str) -> DataFrame:
    """Mean over unit pairs of overlap / sqrt(n_i n_j), per ordered pair of populations.

    ``presence`` has one row per occupied (unit, bin).  The sum over pairs
    factorises: with a_i = 1/sqrt(n_i) and S_A(b) = sum of a_i over the units
    of A present in bin b, all pairs of A and B add up to sum_b S_A(b) S_B(b).
    Within one population the diagonal adds one per unit.  No pair is built.
    """
    size = presence.groupBy(pop, unit).agg((1 / F.sqrt(F.count("*"))).alias("a"))
    units = size.groupBy(pop).agg(F.count("*").alias("units"))
    per_bin = presence.join(size, [pop, unit]).groupBy(time, pop).agg(F.sum("a").alias("s"))
    both = (
        per_bin.groupBy(time)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pop).alias("p"), "s"))).alias("row"))  # one entry per population
        .select(F.explode("row").alias("i"), "row")
        .select("i", F.explode("row").alias("j"))
        .filter("i.p <= j.p")
        .groupBy(F.col("i.p").alias("pop_i"), F.col("j.p").alias("pop_j"))
        .agg(F.sum(F.col("i.s") * F.col("j.s")).alias("dot"))
    )
    ni = units.select(F.col(pop).alias("pop_i"), F.col("units").alias("n_i"))
    nj = units.select(F.col(pop).alias("pop_j"), F.col("units").alias("n_j"))
    same = F.col("pop_i") == F.col("pop_j")
    pairs = F.when(same, F.col("n_i") * (F.col("n_i") + 1) / 2).otherwise(F.col("n_i") * F.col("n_j"))
    dot = F.when(same, (F.col("dot") + F.col("n_i")) / 2).otherwise(F.col("dot"))
    return both.join(ni, "pop_i").join(nj, "pop_j").select("pop_i", "pop_j", (dot / pairs).alias("sync"))


def next_times(df: DataFrame, track: Track, marks: dict[str, Column], time: str) -> DataFrame:
    """For every row, the first later time at which each mark is set (NULL if never)."""
    return running(
        df, track, {n: ("min", F.when(c, F.col(time))) for n, c in marks.items()}, backwards=True, inclusive=False
    )


def lead_lag(df: DataFrame, pop: str, tau: str, far: float, gate: float = 0.1) -> DataFrame:
    """Share of leads minus share of lags; zero unless enough lags are long."""
    t = F.col(tau)
    open_gate = F.col("far_share") > gate
    return (
        df.groupBy(pop)
        .agg(
            F.count(t).alias("n"),
            ((F.count_if(t > 0) - F.count_if(t < 0)) / F.count(t)).alias("ratio"),
            (F.count_if(F.abs(t) > far) / F.count(t)).alias("far_share"),
        )
        .select(
            pop, "n", *[F.when(open_gate, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("ratio", "far_share")]
        )
    )

"""Replicated estimates: half samples, shifted surrogates, tests and barcodes on lag curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import rank_hash


WORD = 32  # rounds that one hash of a unit decides


def membership(rounds: int, *keys: str) -> Column:
    """Words of WORD bits: bit r tells whether a unit belongs to random half r.  Word 0 hashes the keys, word k also k."""
    words = [rank_hash(*keys)]
    for k in range(1, -(-rounds // WORD)):
        parts = F.concat_ws(":", *[F.col(c).cast("string") for c in keys], F.lit(str(k)))
        words.append(F.conv(F.substring(F.md5(parts), 1, 8), 16, 10).cast("bigint"))
    return F.array(*words)


def half_samples(joint: DataFrame, mask: str, rounds: int) -> DataFrame:
    """Joint counts of ``rounds`` random halves of the units: the columns of ``joint`` plus round.

    ``joint`` holds counts per ``membership`` mask.  All rounds come from one
    aggregation with one conditional sum each.
    """
    cells = [c for c in joint.columns if c not in (mask, "n")]

    def inside(r: int) -> Column:
        return F.getbit(F.get(mask, F.lit(r // WORD)), F.lit(r % WORD)) == 1

    sums = [F.sum(F.when(inside(r), F.col("n")).otherwise(F.lit(0))).alias(f"_{r}") for r in range(rounds)]
    wide = joint.groupBy(*cells).agg(*sums)
    rows = F.array(*[F.struct(F.lit(r).cast("bigint").alias("round"), F.col(f"_{r}").alias("n")) for r in range(rounds)])
    return wide.select(*cells, F.inline(rows)).filter("n > 0")


def above_chance(seen: DataFrame, chance: DataFrame, cells: Sequence[str], rounds: int, level: float) -> DataFrame:
    """Cells counted more often than the ``level`` quantile of their counts by chance: (cells, n, th, above).

    ``seen`` has (cells, n), ``chance`` (round, cells, n); a cell that a round never
    hit counts as zero there.
    """
    listed = chance.groupBy(*cells).agg(F.collect_list(F.col("n").cast("double")).alias("_n"))  # one entry per round
    padded = F.sort_array(F.concat("_n", F.array_repeat(F.lit(0.0), F.lit(rounds) - F.size("_n"))))
    h = (rounds - 1) * level
    k, frac = int(h), h - int(h)
    th = F.get(padded, F.lit(k)) * (1 - frac) + F.get(padded, F.lit(min(k + 1, rounds - 1))) * frac
    limit = listed.select(*cells, th.alias("th"))
    out = seen.join(limit, list(cells), "left").withColumn("th", F.coalesce("th", F.lit(0.0)))
    return out.withColumn("above", F.col("n") > F.col("th"))


def compare_replicates(true: DataFrame, surr: DataFrame, by: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """Per group: means of both and whether their [lo, hi] intervals are disjoint.

    A group holds one value per round, so the built-in percentile is enough.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        q = F.percentile(value, F.array(F.lit(lo), F.lit(hi)))
        return df.groupBy(*by).agg(F.avg(value).alias(f"{tag}_mean"), q.alias(f"{tag}_q"))

    both = side(true, "true").join(side(surr, "surr"), list(by))
    apart = (F.col("true_q")[0] > F.col("surr_q")[1]) | (F.col("true_q")[1] < F.col("surr_q")[0])
    return both.select(*by, "true_mean", "surr_mean", apart.alias("differs"))


def hills(curve: Column | str, prominence: float = 1e-3, edge: int = 4) -> Column:
    """Hills of a lag curve: array of struct(peak, first, last), left to right.

    A hill is a peak with everything that falls away from it on both sides; a
    valley belongs to the hill on its right.  At either end fewer than ``edge``
    left-over points join the nearest hill, more of them form a hill of their own.
    """

    @F.pandas_udf("array<struct<peak: int, first: int, last: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def base(v: np.ndarray, p: int, side: np.ndarray) -> float:
            higher = np.flatnonzero(side > v[p])
            part = side[: higher[0]] if len(higher) else side
            return part.min() if len(part) else v[p]

        def split(v: np.ndarray) -> list[dict]:
            v = np.asarray(v, float)
            last = len(v) - 1
            peaks = [
                p
                for p in np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
                if v[p] - max(base(v, p, v[:p][::-1]), base(v, p, v[p + 1 :])) >= prominence
            ]
            step = np.diff(v)
            left_stops = np.concatenate(([0], np.flatnonzero(step < 0) + 1))
            right_stops = np.concatenate((np.flatnonzero(step > 0), [last]))
            out = []
            for p in peaks:
                first = int(left_stops[np.searchsorted(left_stops, p, "right") - 1])
                end = int(right_stops[np.searchsorted(right_stops, p, "left")])
                if out and out[-1]["last"] >= first:
                    out[-1]["last"] = first - 1
                out.append({"peak": int(p), "first": first, "last": end})
            if not out:
                return [{"peak": int(np.argmax(v)), "first": 0, "last": last}]
            if last - out[-1]["last"] >= edge:
                at = out[-1]["last"] + 1
                out.append({"peak": at + int(np.argmax(v[at:])), "first": at, "last": last})
            else:
                out[-1]["last"] = last
            if out[0]["first"] >= edge:
                out.insert(0, {"peak": int(np.argmax(v[: out[0]["first"]])), "first": 0, "last": out[0]["first"] - 1})
            else:
                out[0]["first"] = 0
            return out

        for b in batches:
            yield b.map(split)

    return run(curve)


def barcode(tests: DataFrame, lags: int, reach: int = 3, percent: bool = False) -> DataFrame:
    """(dir, lag, code): effect around significant peaks of the mean curve, zero elsewhere, from lag 0.

    ``tests`` is the result of ``compare_replicates`` by (dir, lag).  A peak counts
    when all but two of the lags within ``reach`` of it differ; it marks itself
    and its two neighbours.
    """
    w = W.partitionBy("dir").orderBy("lag")  # one row per lag
    around = w.rowsBetween(-reach, reach)
    t = tests.withColumn("_sig", F.sum(F.col("differs").cast("int")).over(around)).withColumn("_of", F.count("*").over(around))
    curve = tests.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("lag", "true_mean"))).alias("_c"))
    peak = F.explode(hills(F.transform("_c", lambda p: p["true_mean"]), prominence=0.0)).alias("h")
    at = curve.select("dir", "_c", peak).select("dir", F.get("_c", F.col("h.peak"))["lag"].alias("lag"))
    good = at.join(t, ["dir", "lag"]).filter(F.col("_sig") >= F.col("_of") - 2).select("dir", "lag")
    marked = good.select("dir", F.explode(F.array(F.col("lag") - 1, F.col("lag"), F.col("lag") + 1)).alias("lag")).distinct().withColumn("_on", F.lit(True))
    effect = F.col("true_mean") - F.col("surr_mean")
    bars = t.join(marked, ["dir", "lag"], "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
    if percent:
        top = F.max(F.when(F.col("_on"), F.greatest(F.abs("true_mean"), F.abs("surr_mean")))).over(W.partitionBy(F.lit(1)))
        effect = effect / top * 100
    bars = bars.select("dir", "lag", F.when(F.col("_on"), effect).otherwise(F.lit(0.0)).alias("code"))
    grid = tests.groupBy("dir").agg(F.min("lag").alias("_m"))
    pad = grid.filter("_m > 0").select("dir", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias("lag"), F.lit(0.0).alias("code"))
    return bars.unionByName(pad)


def peaked_runs(runs: DataFrame, curve: DataFrame, keys: Sequence[str], share: float = 0.1) -> DataFrame:
    """Runs of significant lags of which more than ``share`` lie closer to a peak than to a trough.

    ``curve`` (keys, lag, v) and ``runs`` (keys, start, end) are short lag tables;
    distances come from the last and next extremum along the curve.
    """
    w = W.partitionBy(*keys).orderBy("lag")
    v = F.col("v")
    up, down = F.lag(v).over(w), F.lead(v).over(w)
    marks = curve.select("*", ((v > up) & (v > down)).alias("_p"), ((v < up) & (v < down)).alias("_t"))
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)

    def gap(flag: str) -> Column:
        at = F.when(F.col(flag), F.col("lag"))
        return F.least(F.col("lag") - F.max(at).over(back), F.min(at).over(ahead) - F.col("lag"))

    far = F.lit(1 << 30).cast("bigint")
    near = marks.select(*keys, "lag", (F.coalesce(gap("_p"), far) < F.coalesce(gap("_t"), far)).alias("_near"))
    lags = runs.select(*keys, "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("lag"))
    return (
        lags.join(near, [*keys, "lag"])
        .groupBy(*keys, "start", "end")
        .agg(F.count_if("_near").alias("near"), F.count("*").alias("n"))
        .filter(F.col("near") > F.col("n") * share)
        .select(*keys, "start", "end", "near")
    )

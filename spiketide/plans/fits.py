"""Queries: lines fitted to mean spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions import curves
from spiketide.operators import signals
from spiketide.plans.registry import query
from spiketide.plans.signals import vectors

SPLIT, FIRST, LAST = 16.0, 1, 31


def fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Mean spectrum of each label and the two lines over a baseline that fit it best."""
    spec = signals.spectrum(vectors(spark, sf), ["label"], "embedding").filter(F.col("k").between(FIRST, LAST))
    mean = spec.groupBy("label", "k").agg(F.avg("amp").alias("m"))
    curve = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("double").alias("f"), "m"))).alias("c"))
    curve = curve.select("label", F.col("c.f").alias("f"), F.col("c.m").alias("y"))
    return curve.withColumn("fit", curves.lorentz_pair("f", "y", SPLIT))


@query("lorentz_pair")
def lorentz_pair(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf).select("label", "fit.*")


@query("lorentz_pair_stationary", "SELECT CAST(label AS BIGINT) AS label, true AS inside, true AS stationary FROM embeddings GROUP BY label")
def lorentz_pair_stationary(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fit lies inside its bounds and no free parameter is pulled anywhere: the normal equations, as columns."""
    df = fitted(spark, sf)
    span, top = float(LAST - FIRST), F.array_max("y")
    lines = {k: {"a": (F.lit(0.0), 10 * F.pi() * span * top), "g": (F.lit(span / 1000), F.lit(span))} for k in "01"}
    bounds = {f"{n}{k}": lines[k][n] for k in "01" for n in "ag"}
    bounds |= {"f0": (F.lit(float(FIRST)), F.lit(SPLIT)), "f1": (F.lit(SPLIT), F.lit(float(LAST))), "base": (F.lit(0.0), top)}
    power = F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x)
    pulls = curves.pull("fit", "f", "y")
    inside, still = [], []
    for name, (low, high) in bounds.items():
        p = F.col(f"fit.{name}")
        inside.append((p >= low) & (p <= high))
        calm = F.abs(pulls[name]) * F.greatest(F.abs(p), F.lit(1e-3)) <= 1e-6 * power
        still.append(calm | ((p <= low) & (pulls[name] < 0)) | ((p >= high) & (pulls[name] > 0)))
    both = [reduce(lambda a, b: a & b, c) for c in (inside, still)]
    return df.select("label", F.coalesce(both[0], F.lit(False)).alias("inside"), F.coalesce(both[1], F.lit(False)).alias("stationary"))

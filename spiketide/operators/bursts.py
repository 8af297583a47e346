"""Bursts of band power in a spectrogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.operators.inference import exact_quantiles
from spiketide.session import stage


def band_bursts(spec: DataFrame, keys: Sequence[str], level: float, frame_time: float, hz: float, cycles: float = 3.0) -> DataFrame:
    """(keys, band, n0, n1, len, f, amp) from a spectrogram (keys, band, frame, k, amp).

    A frame is on where the band's strongest frequency exceeds the band's
    ``level`` quantile; adjacent frames that are on form a burst, kept when it lasts
    at least ``cycles`` periods of its mean frequency.  The mean index is ``f``; one
    index step is ``hz``.  The keys name one spectrogram, which has a bounded
    number of frames.
    """
    best = spec.groupBy(*keys, "band", "frame").agg(F.max("amp").alias("amp"), F.max_by("k", "amp").alias("k"))
    best = stage(best)
    cut = stage(exact_quantiles(best, ["band"], "amp", [level]).select("band", F.col("q").alias("cut")))
    on = best.join(cut, "band").filter("amp > cut")
    island = F.col("frame") - F.row_number().over(W.partitionBy(*keys, "band").orderBy("frame"))
    runs = on.withColumn("_g", island).groupBy(*keys, "band", "_g").agg(
        F.min("frame").alias("n0"), (F.max("frame") + 1).alias("n1"), F.count("*").alias("len"), F.avg("k").alias("f"), F.avg("amp").alias("amp")
    )
    return runs.filter(F.col("len") * frame_time >= cycles / (F.col("f") * hz)).drop("_g")

"""Estimates over chunks of signals: bootstrap of transfer entropy, active information storage.

A chunk is a bounded stretch of a unit.  What an estimate needs of a chunk is
counted once; rounds then draw chunks and never see a sample again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spiketide.functions.columns import rank_hash
from spiketide.operators.lagged import lagged_joint, transfer_entropy
from spiketide.operators.ordered import Track, dense_rank_of_all
from spiketide.session import stage


def chunks_of(df: DataFrame, track: Track, size: int) -> DataFrame:
    """Samples with their ``chunk``: whole chunks of ``size`` samples of each unit, numbered from 0; a rest is left out."""
    keys = list(track.keys)
    chunk = F.floor(F.col(track.pos) / size)
    length = df.groupBy(*keys).agg(F.count("*").alias("_len"))
    return df.join(length, keys).withColumn("chunk", chunk).filter((F.col("chunk") + 1) * size <= F.col("_len")).drop("_len")


def drawn_chunks(chunks: DataFrame, rounds: int, draws: int, seed: int) -> DataFrame:
    """``round, rank, times``: how often each of ``rounds`` rounds draws a chunk, ``draws`` times with repetition.

    Ranks are 0 .. count - 1; the table has rounds x draws rows at most, however many chunks there are.
    """
    count = chunks.agg(F.count("*")).scalar()
    spark = chunks.sparkSession
    each = spark.range(rounds * draws).select(F.expr(f"id div {draws}").alias("round"), (F.col("id") % draws).alias("_d"), F.lit(seed).alias("_s"))
    hit = F.try_mod(rank_hash("round", "_d", "_s"), count)  # null without chunks
    return each.select("round", hit.alias("rank")).filter("rank is not null").groupBy("round", "rank").agg(F.count("*").alias("times"))


def chunk_bootstrap(df: DataFrame, track: Track, x: str, y: str, size: int, lags: int, rounds: int, draws: int, seed: int) -> DataFrame:
    """``round, lag, dir, te``: transfer entropy of ``draws`` chunks drawn anew in every round.

    Joint counts are made per chunk, inside the chunk; a round adds up the
    counts of its chunks by how often each was drawn.  Without a whole chunk
    there is no row.
    """
    keys = list(track.keys)
    samples = chunks_of(df.select(*keys, track.pos, x, y), track, size)
    inside = Track((*keys, "chunk"), track.pos, track.width, flat=True)  # a chunk is bounded
    counts = lagged_joint(samples, inside, x, y, lags, by=[*keys, "chunk"])
    chunks = stage(dense_rank_of_all(samples.filter(F.col(track.pos) % size == 0).select(*keys, "chunk"), [*keys, "chunk"]))
    drawn = stage(drawn_chunks(chunks, rounds, draws, seed))
    wanted = chunks.join(drawn, "rank").select(*keys, "chunk", "round", "times")
    cells = [c for c in counts.columns if c not in (*keys, "chunk", "n")]
    joint = counts.join(wanted, [*keys, "chunk"]).groupBy("round", *cells).agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    return transfer_entropy(joint, ["round", "lag", "dir"])


# fixed values: coefficients of the asymptotic series of the digamma function, for x^-2, x^-4 ...
SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
SHIFT = 8  # the series is used beyond this


def digamma(x: Column) -> Column:
    """Digamma of a positive column: stepped up by the recurrence, then the asymptotic series."""
    z = x + SHIFT
    out = F.log(z) - 0.5 / z
    for k, c in enumerate(SERIES, 1):
        out = out + c / F.pow(z, F.lit(2.0 * k))
    for k in range(SHIFT):
        out = out - 1 / (x + k)
    return out


def digamma_sql(x: str) -> str:
    z = f"({x} + {SHIFT})"
    series = " + ".join(f"({c!r}) / pow({z}, {2.0 * k})" for k, c in enumerate(SERIES, 1))
    return f"(ln({z}) - 0.5 / {z} + {series} - " + " - ".join(f"1 / ({x} + {k})" for k in range(SHIFT)) + ")"


def active_information(df: DataFrame, track: Track, value: str, size: int, lags: Sequence[int]) -> DataFrame:
    """``lag, chunks, ais``: information in bits that a sample has about the one ``lag`` later, averaged over chunks.

    Samples of a chunk are taken as Gaussian; the estimate of each chunk loses
    its expected value under independence.  All lags use the same first
    size - max(lags) samples.  A chunk with a constant side has no estimate.
    """
    keys, longest = list(track.keys), max(lags)
    n = size - longest
    if n < 3:
        raise ValueError("a chunk needs three samples more than the longest lag")
    samples = chunks_of(df.select(*keys, track.pos, F.col(value).cast("double").alias("_v")), track, size)
    w = W.partitionBy(*keys, "chunk").orderBy(track.pos)
    led = samples.select("*", *[F.lead("_v", k).over(w).alias(f"_{k}") for k in lags]).filter(F.col(track.pos) % size < n)
    wide = led.groupBy(*keys, "chunk").agg(
        *[F.try_divide(F.covar_pop("_v", f"_{k}"), F.stddev_pop("_v") * F.stddev_pop(f"_{k}")).alias(f"r{k}") for k in lags]
    )
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])))
    half = F.lit(n / 2.0)
    bias = (digamma(half - 1.0) - digamma(half - 0.5)) / 2
    mi = (bias - F.log(1 - F.col("r") * F.col("r")) / 2) / math.log(2)
    return rows.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < 1)).groupBy("lag").agg(F.count("*").alias("chunks"), F.avg(mi).alias("ais"))

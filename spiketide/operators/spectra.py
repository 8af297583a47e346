"""Spectra of signals that are stored one sample a row, of any length.

A whole signal never comes together: its transform at some frequencies is a sum
over rows.  Frames are cut where the samples are: a chunk borrows the samples
its last frames need from the next one, and all frames of a chunk are
transformed at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spiketide.functions import spectral
from spiketide.operators.ordered import CHUNK, Track, halo
from spiketide.session import stage


def _sample(value: str) -> Column:
    """The sample, or null where it is null or NaN."""
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def row_spectrum(df: DataFrame, track: Track, value: str, k0: int, k1: int, nbin: int | None = None) -> DataFrame:
    """``keys, size, k, amp``: 2 / size |DFT| of each whole signal for the frequency indices k0 .. k1 - 1 below size / 2.

    ``size`` is the length of the signal, or ``nbin``: shorter signals are
    padded with zeros, of longer ones the first ``nbin`` samples count.  Null
    and NaN samples count as zero.  Sums are formed in each task, so a row never
    leaves it.
    """
    keys = list(track.keys)
    rows = df.select(*keys, track.pos, F.coalesce(_sample(value), F.lit(0.0)).alias("_v"))
    if nbin is None:
        size = stage(rows.groupBy(*keys).agg(F.count("*").alias("size")))
        rows = rows.join(size, keys)
    else:
        rows = rows.withColumn("size", F.lit(nbin).cast("bigint")).filter(F.col(track.pos) < nbin)
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(k0).cast("bigint"), F.lit(k1 - 1).cast("bigint"))))
    each = each.filter(F.col("k") < F.expr("size div 2"))
    turn = 2 * np.pi * F.pmod(F.col("k") * F.col(track.pos), F.col("size")) / F.col("size")
    sums = each.groupBy(*keys, "size", "k").agg(F.sum(F.col("_v") * F.cos(turn)).alias("re"), F.sum(F.col("_v") * F.sin(turn)).alias("im"))
    return sums.select(*keys, "size", "k", (F.lit(2.0) / F.col("size") * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("amp"))


def frame_spectrum(df: DataFrame, track: Track, value: str, width: int, hop: int, nbin: int | None = None, hann: bool = True) -> DataFrame:
    """``keys, frame, amps``: 2 / nbin |DFT| of the frames of ``width`` samples that start at frame * hop.

    ``amps`` holds the first nbin / 2 frequencies; ``nbin`` above ``width`` pads
    with zeros.  A frame needs all its samples and one after it, and none of
    them null or NaN.  Positions must be dense and start at 0.
    """
    if nbin is not None and nbin < width:
        raise ValueError("a frame is padded, never cut")
    keys, pos, size = list(track.keys), track.pos, nbin or width
    track = track.at(pos, width=max(track.width, width))
    wide, _ = halo(df.select(*keys, pos, _sample(value).alias("_v")), track, ahead=width)
    parts = keys if track.flat else [*keys, CHUNK]
    kinds = {f.name: f.dataType for f in df.schema}
    schema = pa.schema([*[(k, to_arrow_type(kinds[k])) for k in keys], ("frame", pa.int64()), ("amps", pa.list_(pa.float64()))])

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        n, x = table[pos].to_numpy(), table["_v"].to_numpy()
        own = table["_own"].to_numpy(zero_copy_only=False)
        first = int(n[0])
        last = int(n[own][-1]) if own.any() else first - 1  # copies alone: there is no chunk before the first
        frames = np.arange(-(-first // hop), last // hop + 1)
        at = frames * hop - first
        frames, at = frames[at + width < len(x)], at[at + width < len(x)]
        cuts = x[at[:, None] + np.arange(width)] if len(at) else np.empty((0, width))
        whole = ~np.isnan(cuts).any(axis=1)
        frames, cuts = frames[whole], cuts[whole]
        amps = 2 / size * np.abs(np.fft.rfft(cuts * np.hanning(width) if hann else cuts, size, axis=1)[:, : size // 2])
        lists = pa.ListArray.from_arrays(np.arange(len(amps) + 1, dtype="i4") * (size // 2), np.ascontiguousarray(amps).ravel())
        return pa.Table.from_arrays([pa.array([table[k][0].as_py()] * len(frames), schema.field(k).type) for k in keys] + [pa.array(frames), lists], schema=schema)

    ddl = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", frame long, amps array<double>"
    return wide.groupBy(*parts).applyInArrow(cut, ddl)


def bins(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, k, amp``: one row for each frequency of each frame."""
    return frames.select(*keys, F.posexplode("amps").alias("k", "amp")).withColumn("k", F.col("k").cast("bigint"))


def band(amps: Column | str, k0: int, k1: int) -> Column:
    """Mean amplitude of the frequency indices k0 .. k1."""
    part = F.slice(amps, k0 + 1, k1 - k0 + 1)
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / (k1 - k0 + 1)


def window_spectrum(df: DataFrame, track: Track, value: str, starts: DataFrame, width: int) -> DataFrame:
    """``keys, window, amps`` of the windows ``starts`` (keys, window, start) asks for; incomplete ones are left out.

    A window asks for each of its samples, so a unit's rows are joined by
    position and no unit comes together.
    """
    keys, pos = list(track.keys), track.pos
    asked = starts.select(*keys, "window", F.posexplode(F.sequence(F.col("start"), F.col("start") + (width - 1))).alias("_j", pos))
    got = asked.join(df.select(*keys, pos, _sample(value).alias("_v")).filter("_v is not null"), [*keys, pos])
    whole = got.groupBy(*keys, "window").agg(F.sort_array(F.collect_list(F.struct("_j", "_v"))).alias("_s")).filter(F.size("_s") == width)
    return whole.select(*keys, "window", spectral.amplitude(F.col("_s._v")).alias("amps"))


def mean_spectrum(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, k, n, amp``: the spectrum averaged over frames or windows."""
    return bins(frames, keys).groupBy(*keys, "k").agg(F.count("*").alias("n"), F.avg("amp").alias("amp"))


def peak_frequency(mean: DataFrame, keys: Sequence[str], k0: int, k1: int) -> DataFrame:
    """``keys, k, amp``: the highest of the indices k0 .. k1, of equal ones the lowest index."""
    best = F.max(F.struct("amp", (-F.col("k")).alias("k")))
    top = mean.filter((F.col("k") >= k0) & (F.col("k") <= k1)).groupBy(*keys).agg(best.alias("_b"))
    return top.select(*keys, (-F.col("_b.k")).alias("k"), F.col("_b.amp").alias("amp"))

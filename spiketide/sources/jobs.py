"""All files of one job of a run directory."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import decode_index
from spiketide.sources import binary, text


class Job(NamedTuple):
    """Tables of one job; a file that the directory does not have gives an empty table."""

    job_id: int
    spikes: DataFrame
    signals: DataFrame
    edges: DataFrame
    pairs: DataFrame
    summary: DataFrame

    def pair_spikes(self) -> DataFrame:
        """Spikes of the selected units: (t_id, r_id, delay, role, step), role T for the transmitter and R for the receiver."""
        ends = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("neuron_id")) for role, c in (("T", "t_id"), ("R", "r_id"))])
        units = self.pairs.select("t_id", "r_id", "delay", F.inline(ends))
        return units.join(self.spikes.select("neuron_id", "step"), "neuron_id").select("t_id", "r_id", "delay", "role", "step")

    def receiver_targets(self) -> DataFrame:
        """(t_id, r_id, post): what each pair's receiver projects to."""
        return self.pairs.join(self.edges, F.col("r_id") == F.col("pre")).select("t_id", "r_id", "post")

    def between(self, fs: float, start: float, end: float) -> DataFrame:
        """Signals of the seconds [start, end)."""
        return self.signals.filter((F.col("n") >= int(start * fs)) & (F.col("n") < int(end * fs)))


def load_job(spark: SparkSession, path: str, job_id: int) -> Job:
    """The spikes, signals, network, selected pairs and summary of one job.

    Only files whose number ends like the job's are listed, and of those only
    rows of the job itself are kept, so the other jobs are not read.
    """

    def own(df: DataFrame) -> DataFrame:
        return df.filter(F.col("job_id") == job_id).drop("job_id")

    name = f"id*{job_id}_"
    return Job(
        job_id,
        own(binary.read_spikes(spark, path, f"{name}spk.dat")),
        own(binary.read_lfp(spark, path, f"{name}lfp.dat")),
        own(text.read_adjacency(spark, path, f"{name}adj.txt")),
        own(text.read_pairs(spark, path, f"{name}trinfo.txt")),
        own(text.read_summaries(spark, path, f"{name}result.txt")),
    )


def job_of(sizes: tuple[int, ...], position: tuple[int, ...]) -> int:
    """Number of the job at a position of the sweep's axes, the last axis fastest."""
    number = 0
    for size, at in zip(sizes, position, strict=True):
        if not 0 <= at < size:
            raise ValueError(f"position {position} is outside a sweep of {sizes}")
        number = number * size + at
    return number


def positions(jobs: DataFrame, sizes: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """Jobs with their place on each axis as columns."""
    return jobs.select("*", *[c.alias(n) for c, n in zip(decode_index(F.col("job_id"), sizes), names, strict=True)])

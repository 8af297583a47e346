"""One job of a run directory with all its files."""

from __future__ import annotations

import numpy as np
import pytest

from spiketide.sources import jobs


@pytest.fixture()
def folder(tmp_path):
    for number, shift in ((2, 0), (12, 100)):
        job = f"id{number:06d}"
        np.array([3, 100, 2, 0, 2, 5 + shift, 9 + shift, 7 + shift, 8 + shift], "<i4").tofile(tmp_path / f"{job}_spk.dat")
        np.array([2, 10, *range(30)], "<f4").tofile(tmp_path / f"{job}_lfp.dat")
        (tmp_path / f"{job}_adj.txt").write_text("0<-2,\n1<-2,0,\n")
        (tmp_path / f"{job}_trinfo.txt").write_text("ID(T),ID(R),delay\n0,2,4\n")
        (tmp_path / f"{job}_result.txt").write_text(f"num_types:2\nchi:0.5,{number},0.25,\ncv:0.2,0.1,0.3,\nfrs_m:5,6,7,\nfrs_s:1,1,1,\n")
    return str(tmp_path)


def test_only_the_rows_of_the_job(spark, folder):
    job = jobs.load_job(spark, folder, 2)  # id000012 ends like it too
    assert sorted(map(tuple, job.spikes.collect())) == [(0, 5), (0, 9), (2, 7), (2, 8)]
    assert sorted(map(tuple, job.edges.collect())) == [(0, 1), (2, 0), (2, 1)]
    assert {r["pop"]: r["chi"] for r in job.summary.collect()} == {"total": 0.5, "F": 2.0, "S": 0.25}
    spikes = sorted((r.role, r.step) for r in job.pair_spikes().collect())
    assert spikes == [("R", 7), ("R", 8), ("T", 5), ("T", 9)]
    assert sorted(r.post for r in job.receiver_targets().collect()) == [0, 1]
    assert sorted((r["pop"], r["n"]) for r in job.between(10.0, 0.2, 0.4).collect()) == [(p, n) for p in ("F", "S", "total") for n in (2, 3)]


def test_a_job_without_files_is_empty(spark, folder):
    job = jobs.load_job(spark, folder, 7)
    assert job.spikes.count() == job.pair_spikes().count() == job.summary.count() == 0


def test_places_on_the_axes(spark):
    assert jobs.job_of((2, 3), (1, 2)) == 5
    with pytest.raises(ValueError):
        jobs.job_of((2, 3), (1, 3))
    rows = jobs.positions(spark.range(6).withColumnRenamed("id", "job_id"), (2, 3), ("a", "b")).orderBy("job_id").collect()
    assert [(r.a, r.b) for r in rows] == [(a, b) for a in range(2) for b in range(3)]
    assert [jobs.job_of((2, 3), (r.a, r.b)) for r in rows] == list(range(6))

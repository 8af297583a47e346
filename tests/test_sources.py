"""Run files written by the tests, read back by the sources."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spiketide.operators import sweeps
from spiketide.sources import binary, sinks, text


def test_spikes(spark, tmp_path):
    np.array([3, 100, 2, 0, 1, 5, 9, 7], "<i4").tofile(tmp_path / "id000012_spk.dat")
    got = [tuple(r) for r in binary.read_spikes(spark, str(tmp_path)).orderBy("neuron_id", "step").collect()]
    assert got == [(12, 0, 5), (12, 0, 9), (12, 2, 7)]


def test_lfp_and_mua(spark, tmp_path):
    np.array([2, 2000, 1, 2, 3, 4, 5, 6], "<f4").tofile(tmp_path / "id000001_lfp.dat")
    got = [tuple(r) for r in binary.read_lfp(spark, str(tmp_path)).orderBy("pop", "n").collect()]
    assert got[:2] == [(1, "F", 0, 0.0, 3.0), (1, "F", 1, 0.0005, 4.0)] and len(got) == 6
    np.array([0.5, 10, 1, 2, 3, 4], "<f4").tofile(tmp_path / "id000001_mua.dat")
    got = [tuple(r) for r in binary.read_mua(spark, str(tmp_path)).orderBy("pop", "n").collect()]
    assert got[1] == (1, "F", 1, 10.5, 2.0) and got[2] == (1, "S", 0, 10.0, 3.0)


def test_dynamics(spark, tmp_path):
    np.arange(6, dtype="<f4").tofile(tmp_path / "id000003_v.dat")
    got = [tuple(r) for r in binary.read_dynamics(spark, str(tmp_path), 2, 10.0).orderBy("n", "neuron_id").collect()]
    assert got[3] == (3, 1, 0.1, 1, 3.0)


def test_network_files(spark, tmp_path):
    (tmp_path / "id000000_net.txt").write_text("adjacency list, w (N=3)\n0<-1,0.500000\n2<-0,1.25\n")
    got = [tuple(r) for r in text.read_network(spark, str(tmp_path), "*_net.txt").orderBy("pre").collect()]
    assert got == [(0, 0, 2, 1.25), (0, 1, 0, 0.5)]
    (tmp_path / "id000000_adj.txt").write_text("0<-1,2,\n1<--1,0,\n-1<-0,\n")
    got = [tuple(r) for r in text.read_adjacency(spark, str(tmp_path)).orderBy("pre", "post").collect()]
    assert got == [(0, 0, 1), (0, 1, 0), (0, 2, 0)]
    (tmp_path / "id000000_trinfo.txt").write_text("ID(T),ID(R)\n10,1200,4\n11,1300,6\n")
    got = [tuple(r) for r in text.read_pairs(spark, str(tmp_path)).orderBy("t_id").collect()]
    assert got == [(0, 10, 1200, 4), (0, 11, 1300, 6)]


def test_catalog(spark, tmp_path):
    (tmp_path / "control_params.txt").write_text("2,2,\nalpha:0.0,1.0,\nbeta:0.5,0.7,\n")
    (tmp_path / "id000002_result.txt").write_text("num_types:2\nchi:0.5,nan,0.25,\ncv:0.2,-1.000000,0.3,\nfrs_m:5,6,7,\nfrs_s:1,1,1,\n")
    axes = text.read_axes(spark, str(tmp_path))
    assert [tuple(r) for r in axes.orderBy("name", "idx").collect()] == [("alpha", 0, 0.0), ("alpha", 1, 1.0), ("beta", 0, 0.5), ("beta", 1, 0.7)]
    jobs = sweeps.expand(spark, {"alpha": [0.0, 1.0], "beta": [0.5, 0.7]})
    cat = sweeps.attach_results(jobs, text.read_summaries(spark, str(tmp_path)))
    got = {(r["job_id"], r["pop"]): r for r in cat.collect()}
    assert got[(2, "F")]["chi"] is None and got[(2, "F")]["cv"] is None and got[(2, "S")]["cv"] == 0.3
    assert (got[(2, "total")]["alpha"], got[(2, "total")]["beta"]) == (1.0, 0.5)
    assert got[(0, None)]["chi"] is None and len(got) == 6


@pytest.mark.parametrize("with_seed", [False, True])
def test_params_round_trip(spark, tmp_path, with_seed):
    w, p, nu = [1.0, 2.0, 3.0, 4.0], [[float(4 * i + j) / 10 for j in range(4)] for i in range(4)], [0.5, 0.25]
    df = spark.createDataFrame([(7, w, p, nu, 0.9, 12.5)], "seed bigint, w array<double>, p array<array<double>>, nu array<double>, wratio double, tdelay double")
    sinks.param_lines(df, with_seed).coalesce(1).write.text(str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("part-*")).read_text()
    (tmp_path / "params_to_run.txt").write_text("1\n" + line)
    r = text.read_params(spark, str(tmp_path), with_seed).first()
    assert (r["w"], r["p"], r["nu"]) == (w, p, nu)
    assert (r["seed"], r["tdelay"]) == ((7, 12.5) if with_seed else (None, None))
    (tmp_path / "params_to_run.txt").write_text("3\n" + line.strip() + "\n\n" + line)
    assert sorted(r["job_id"] for r in text.read_params(spark, str(tmp_path), with_seed).collect()) == [0, 2]
    (tmp_path / "params_to_run.txt").write_text("2\n" + line.strip() + "\n1,2,3\n")
    with pytest.raises(Exception, match="a parameter line has"):
        text.read_params(spark, str(tmp_path), with_seed).collect()


def test_axis_lines(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0)], "name string, idx int, value double")
    assert sinks.axis_lines(df).first()[0] == "a:1.0,2.0,"


def test_table_sink(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("job_id"), "id")
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    assert spark.read.parquet(path).filter("job_id = 1").count() == 33
    with pytest.raises(AnalysisException):
        sinks.write_table(df, path)
    sinks.write_table(df.limit(5), path, replace=True)
    assert spark.read.parquet(path).count() == 5
    jobs = spark.range(5).withColumnRenamed("id", "job_id")
    assert sorted(r[0] for r in sinks.pending_jobs(jobs, spark.read.parquet(path)).collect()) == [3, 4]


def test_downsample(spark):
    assert sinks.downsample(spark.range(250), "id", 0.01, 2000).count() == 5


def test_cached_table(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.cached_table(spark, str(tmp_path), params, compute).count() == 3
    assert len(calls) == 2


def test_bundle_sink(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).alias("job_id"), "id")
    sinks.write_bundle({"spikes": df, "signals": df.limit(0)}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "spikes")).count() == 6
    with pytest.raises(AnalysisException):
        sinks.write_bundle({"spikes": df}, str(tmp_path / "run"))

"""Every query beside its SQL, with chunks so narrow that all borders are crossed."""

from __future__ import annotations

import pytest

from spiketide import catalog
from tests import oracle

SF = f"{oracle.ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.fixture(scope="module", autouse=True)
def narrow(spark):
    spark.conf.set("spark.spiketide.chunkWidth", "16")
    yield
    spark.conf.unset("spark.spiketide.chunkWidth")


LONG = [n for n in catalog.PLANS if n.startswith(("kmeans_", "nmf_")) and n != "kmeans_restarts"]  # shorter runs are in test_kmeans and test_nmf


@pytest.mark.parametrize("name", [n for n in catalog.PLANS if n not in LONG])
def test_query(spark, con, name):
    assert oracle.compare(spark, con, name, SF) == []


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["pop", "units", "cv"]


ORDERED = (
    "cv_isi lead_lag_ratio rle_states gap_fill absorb_short interval_stab peaks_nearest session_bursts event_response "
    "joint_presence_2x2 lagged_joint_hist cross_corr te_shift_surrogates motif_chunks linear_interpolation gaussian_smooth "
    "peak_prominence peak_prominence_hot frame_spectrum row_spectrum band_motifs"
).split()


@pytest.mark.parametrize("name", ORDERED)
def test_some_units_are_hot(spark, con, name):
    """Units have 49 to 86 events: at a width of 66 some are cut into chunks and some are not."""
    before = spark.conf.get("spark.spiketide.chunkWidth")
    spark.conf.set("spark.spiketide.chunkWidth", "66")
    try:
        assert oracle.compare(spark, con, name, SF) == []
    finally:
        spark.conf.set("spark.spiketide.chunkWidth", before)

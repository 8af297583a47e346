"""All registered queries."""

from __future__ import annotations

import importlib

from spiketide.plans.registry import PLANS, SQL

for _m in ("rates", "histograms", "segments", "joins", "inference", "signals", "clusters", "kmeans", "peaks", "spectra", "routes", "sweeps", "streams", "replicates", "chunked", "nmf", "maps", "fits"):
    importlib.import_module(f"spiketide.plans.{_m}")

__all__ = ["PLANS", "SQL"]

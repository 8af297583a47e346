from __future__ import annotations

import pytest

from spiketide.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "spiketide-tests", partitions=4)
    yield s
    s.stop()

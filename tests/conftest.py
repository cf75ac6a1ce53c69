from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from scales import SF_MID, SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from grainline.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="grainline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from oracle import duck

    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from oracle import duck

    return duck(SF_MID)

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sievework.session import local_session

    s = local_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SMALL

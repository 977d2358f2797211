import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from marlstone.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, partitions=4, memory="6g")
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA

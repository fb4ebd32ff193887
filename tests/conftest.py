import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

from nearfold.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from flowlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("*", shuffle_partitions=4, memory="6g")

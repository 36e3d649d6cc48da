import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from officelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["OFFICELAKE_LOCAL_ROOT"] = str(tmp_path_factory.mktemp("shared"))
    session = build_session("4", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()

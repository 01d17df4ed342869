import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomkit.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(cpus="*", shuffle_partitions=8, app="loomkit-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomkit-test-ckpt-"))
    yield s
    s.stop()

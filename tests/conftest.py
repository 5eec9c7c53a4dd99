import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, partitions=4, driver_memory="6g")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqspark-ckpt-"))
    yield s
    s.stop()

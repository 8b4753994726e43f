import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from souk.session import get_spark

    return get_spark(master="local[*]", shuffle_partitions=8,
                     checkpoint_dir=tempfile.mkdtemp(prefix="souk-test-ckpt-"))

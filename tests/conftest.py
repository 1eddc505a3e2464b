import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scrubline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def fresh_path(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    return lambda name="f": str(root / f"{name}-{uuid.uuid4().hex[:8]}")


@pytest.fixture(scope="session")
def sf():
    return SF

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadastra.session import local_session  # noqa: E402

DATA = os.environ.get("CADASTRA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "cadastra-tests")


@pytest.fixture(scope="session")
def data_dir():
    return DATA

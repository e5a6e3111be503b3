import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect  # noqa: E402

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def con():
    return connect(SMALL)


@pytest.fixture(scope="session")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())

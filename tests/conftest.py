import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    s = session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=shared
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

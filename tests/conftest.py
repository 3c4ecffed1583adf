import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from skein.session import get_or_create

    session = get_or_create("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    return session

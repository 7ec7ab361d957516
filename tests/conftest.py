import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from certlake.session import build_session

    session = build_session("local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from metrilark.session import session, ship

    s = ship(session("local[4]", 4))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

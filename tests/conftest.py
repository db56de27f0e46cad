import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests"), str(ROOT / "tests" / "llm")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()

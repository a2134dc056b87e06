import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF = os.environ.get("TICKLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import build_session

    session = build_session(int(os.environ.get("TICKLOOM_TEST_CORES", "8")), "tickloom-tests", **{"spark.driver.memory": "8g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF

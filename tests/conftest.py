import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cytoplane.session import get_spark

    session = get_spark("tests", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not SMALL.exists():
        pytest.skip("no test tables")
    return str(SMALL)

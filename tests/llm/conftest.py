import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the workers

from tarkash.sources import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests")
    s.sparkContext.setLogLevel("ERROR")
    return s

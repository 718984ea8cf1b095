import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])  # workers import fakes too


@pytest.fixture(scope="session")
def spark():
    from driftaudit.session import local_session

    return local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from runnel.session import local_session

    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session

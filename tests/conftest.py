import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shardloom.session import build_session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = build_session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__checkpoint__dir=str(folder), spark__sql__warehouse__dir=str(folder / "warehouse")
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

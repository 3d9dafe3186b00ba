import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skein.session import session

    tmp = tmp_path_factory.mktemp("spark")
    s = session(
        "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__local__dir=str(tmp), spark__sql__warehouse__dir=f"{tmp}/warehouse", spark__checkpoint__dir=f"file://{tmp}/shared",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

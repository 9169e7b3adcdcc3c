import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from petalstream.plans.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=str(folder / "shared"),
        spark__sql__warehouse__dir=str(folder / "warehouse"), spark__sql__session__timeZone="UTC",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)

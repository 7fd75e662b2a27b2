import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from prefloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def samples(spark):
    """rows: (dataset_idx, sample_idx, split, prompt, chosen, rejected)"""

    def make(rows):
        return spark.createDataFrame(rows, "dataset_idx int, sample_idx long, split string, prompt string, chosen string, rejected string")

    return make


SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.exists():
        pytest.skip("the test tables are not here")
    return str(SF)

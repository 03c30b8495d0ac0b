import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from routeledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def make_files(spark):
    def build(files: dict[str, str], repo: str = "r"):
        rows = [(repo, path, content) for path, content in files.items()]
        return spark.createDataFrame(rows, "repo string, rel_path string, content string")

    return build

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Build ``files(repo_id, path, content, size)`` from a dict of paths."""

    def make(contents: dict[str, str], repo: str = "o/r"):
        rows = [(repo, path, text, len(text.encode())) for path, text in contents.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, content string, size long")

    return make

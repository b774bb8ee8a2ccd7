import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import build_session  # noqa: E402
from plumbline.sources.files import FILE_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """File table from {repo: {path: content}}, listed in the order given."""
    def build(repos):
        rows = [
            (repo, "develop", i, path, content)
            for repo, listing in repos.items() for i, (path, content) in enumerate(listing.items())
        ]
        return spark.createDataFrame(rows, FILE_SCHEMA)

    return build


@pytest.fixture(scope="session")
def make_dictionary(spark):
    return lambda *words: spark.createDataFrame([(w,) for w in words], "key string")

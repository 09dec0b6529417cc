import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from notelake.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return SF_DIR


ENTRY_DDL = (
    "id bigint, role string, category string, text string, embedding array<float>, "
    "tags array<string>, created_at string"
)


@pytest.fixture
def entries(spark):
    """Build entries from (id, text[, embedding[, category]]) tuples."""

    def build(rows, role="coder"):
        full = []
        for row in rows:
            row = list(row) + [None] * (4 - len(row))
            vector = None if row[2] is None else [float(x) for x in row[2]]
            full.append((row[0], role, row[3] or "notes", row[1], vector, [], "2024-01-01"))
        return spark.createDataFrame(full, ENTRY_DDL)

    return build

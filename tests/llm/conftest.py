import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import SCHEMA, edge_texts  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(k, t, [None, "en", "fr"][j % 3], [None, "a", "b"][j % 3], None if j % 4 == 0 else j, "c", "b", "p", "n", None) for j, (k, t) in enumerate(edge_texts())]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

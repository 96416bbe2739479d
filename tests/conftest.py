import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tapewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tiny_chunks(spark):
    """Cut every key into small chunks, so that all order-dependent code crosses chunk borders."""
    from tapewright.operators.ordered import ROWS_PER_CHUNK_CONF

    spark.conf.set(ROWS_PER_CHUNK_CONF, "7")
    yield
    spark.conf.unset(ROWS_PER_CHUNK_CONF)

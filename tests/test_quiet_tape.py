"""Queries on tapes without a silence, so without a gap to repair."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import compare, duck


@pytest.fixture(scope="module")
def quiet(tmp_path_factory):
    """Two symbols with an event every hour for five days."""
    folder = str(tmp_path_factory.mktemp("quiet"))
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 2 * 60) MINUTE AS ts, i % 2 AS user_id,
      ['click', 'error', 'purchase', 'signup', 'view'][i * 7 % 5 + 1] AS event_type, CAST(i * 37 % 101 AS DOUBLE) AS value, '{{"k": ' || (i * 13 % 100) || '}}' AS props
      FROM range(240) t(i)) TO '{folder}/events.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["G5_backfill_summary", "R4_registry_tables"])
def test_tape_without_gaps_equals_sql(spark, quiet, name):
    assert compare(entry.queries()[name](spark, quiet), duck(quiet), entry.oracle_sql()[name]) is None

"""Registered queries against their SQL on the smallest tables.

All of them run with CHECK_ALL=1; otherwise a few that cover the main kinds.
"""

import os

import pytest

from checks.compare import compare, connect
from checks.registry import CHECKS

SF_DIR = "/root/testdata/sf0.001"
SOME = ("accuracy_by_strategy", "prf", "routing", "row_checks", "open_match", "demo_draw", "contamination_exact", "strata")


@pytest.fixture(scope="module")
def tables():
    pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(CHECKS) if os.environ.get("CHECK_ALL") else SOME)
def test_registered_query_equals_its_sql(spark, tables, name):
    check = CHECKS[name]
    result, _, _ = compare(spark, tables, SF_DIR, check.query, check.sql)
    assert result.startswith("ok "), result


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["model", "condition", "thinking", "strategy", "variant", "n", "accuracy"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query with SQL agrees with it; the others give rows."""

from __future__ import annotations

import pytest

from regionhour.plans import registry
from tests.compare import connect, differences

SMALL = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
WITHOUT_SQL = {"clean_report_text", "normalize_unicode", "extract_page_links"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert differences(registry.queries()[name](spark, SMALL), con, ORACLES[name]) is None


def test_only_known_queries_lack_sql():
    assert set(registry.queries()) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs_without_sql(spark, name):
    df = registry.queries()[name](spark, SMALL)
    assert df.columns and (name == "extract_page_links" or df.count() > 0)

"""Every registered query against its SQL statement, whole tables on both sides."""

import pytest

from __spark_entry__ import entry
from compare import compare, duck
from plumbline.checks.oracle import statements
from plumbline.checks.queries import queries

SF_DIR = "/root/testdata/sf0.001"
SQL = statements()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_statement():
    assert set(queries()) <= set(SQL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, con, name):
    verdict = compare(spark, con, queries()[name], SQL[name], SF_DIR)
    assert verdict in ("", "both sides empty"), verdict


def test_entry_has_a_row_per_repository(spark):
    card = entry(spark)
    assert card.count() == card.select("repo").distinct().count() == 8

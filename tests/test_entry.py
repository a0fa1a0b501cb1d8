import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as contract  # noqa: E402
import check_oracle  # noqa: E402

SF = "/root/testdata/sf0.001"
# The queries of the package itself; those of optional parts are tested beside them.
from perigee.plans.catalog import QUERIES as CORE  # noqa: E402


def test_entry_gives_incidents(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "severity" in df.columns


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(CORE))
def test_query_agrees_with_sql(spark, name):
    message, _ = check_oracle.compare(spark, check_oracle.connect(SF), name, SF)
    assert message == "" or message.startswith("rows only")

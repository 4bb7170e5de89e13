import os

import pytest

import __spark_entry__ as driver
from checks.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    return duck(FOLDER)


def test_entry_has_rows(spark):
    assert driver.entry(spark).columns == [
        "chave", "soma_a", "soma_b", "diff", "has_a", "has_b", "status", "grupo",
    ]
    assert driver.entry(spark).count() > 0


def test_every_expected_result_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    found = difference(driver.queries()[name](spark, FOLDER), sql, driver.oracle_sql()[name])
    assert found is None


@pytest.mark.parametrize("name, ledger, limit", [("reversal_chains", "LEDGER_LINES", 25.0), ("reversal_hot_cell", "LEDGER_HOT", 1.0), ("reversal_dual", "LEDGER_DUAL", 0.5)])
def test_reversals_follow_the_rule(spark, name, ledger, limit):
    """Every row against the rule applied row by row, beside the SQL."""
    from checks import ledgers
    from tests.test_reversal import expected_marks

    marks = driver.queries()[name](spark, FOLDER).collect()
    rows = spark.sql(getattr(ledgers, ledger)).orderBy("row_id").collect()
    plain = [(r["row_id"], r["doc"], r["ref"], float(r["valor"])) for r in rows]
    got = {r["row_id"]: (r["status"], r["grupo"]) for r in marks}
    assert got == expected_marks(plain, limit)

"""Layer 1: every registered job with a SQL twin equals DuckDB at sf0.01."""

import pytest

from fairplay.plans.catalog import load_all
from tests.conftest import SF_CHECK

SQL_JOBS = sorted(n for n, e in load_all().items() if e.sql is not None)


@pytest.mark.parametrize("name", SQL_JOBS)
def test_job_matches_oracle(spark, duck, name):
    from fairplay.plans.verify import compare

    r = compare(spark, name, SF_CHECK, duck)
    assert r["status"] == "ok", r


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90

"""Every named query of the audit engine against its SQL, or at least to the end."""

import pytest
from auditlake.plans import catalogue
from helpers import DATA, agrees


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, DATA)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        agrees(df, duck, sql)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from attesta.plans import catalog


def rows(frame):
    """Rows as text; pandas turns whole numbers into floats where a column has nulls, so whole floats are whole numbers."""
    columns = sorted(frame.columns)
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(repr([whole(x) for x in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the core against its SQL, over the whole small tables."""

import pytest

from loomline.plans.registry import ORACLE, QUERIES
from tests.compare import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    found = rows_of(QUERIES[name](spark, data))
    assert found, name
    if name in ORACLE:
        assert found == sql_rows(data, ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Each registered query against its SQL."""

from __future__ import annotations

import pytest

from siftstone.plans.catalog import ORACLES, QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA).toArrow()
    if name not in ORACLES:
        assert found.num_columns
        return
    wanted = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    columns = sorted(found.column_names)
    assert [str(found.schema.field(c).type) for c in columns] == [str(wanted.schema.field(c).type) for c in columns]

    def rows(table):
        return sorted(map(repr, zip(*(table.column(c).to_pylist() for c in columns), strict=True)))

    assert rows(found) == rows(wanted)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())

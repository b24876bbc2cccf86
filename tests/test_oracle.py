import pytest

from docgauge import queries as core
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, data, db, name):
    assert_same(core.queries()[name](spark, data), db, core.oracle_sql()[name])


def test_entry_has_rows(spark, data):
    assert core.flagship(spark, data).count() > 0

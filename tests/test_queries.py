import pytest

from meridia.plans import queries as plans

from .conftest import DATA, same_rows


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_has_the_rows_of_its_sql(spark, name):
    same_rows(plans.queries()[name](spark, f"{DATA}/sf0.001"), plans.oracle_sql()[name], "sf0.001")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

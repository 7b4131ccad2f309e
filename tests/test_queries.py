import pytest

from compare import same
from quarry.plans import ORACLE, PLANS


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, sf, name):
    df = PLANS[name](spark, sf)
    if name in ORACLE:
        same(df, duck, ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query of the engine against its SQL."""

import pytest

from munjang.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, same, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"cal_2_fit", "agg_17_class_means"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())

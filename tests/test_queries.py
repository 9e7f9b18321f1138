import pytest

import __spark_entry__ as entry
from tests.duck import assert_same, connect
from trackmill import queries as own


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_oracle(spark, small, name):
    assert_same(own.queries()[name](spark, small), connect(small), own.oracle_sql()[name])


def test_every_query_has_an_oracle():
    assert set(own.queries()) == set(own.oracle_sql())


def test_lines_are_split_once(spark, small):
    plan = own.queries()["text_round_trip"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["event_id", "plate_number", "day", "score"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_correction_shuffles_once(spark, small):
    plan = own.queries()["correct_trajectory"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan

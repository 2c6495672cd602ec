"""Every registered query: equal to its SQL, or at least non-empty with named columns."""

import pytest

import __spark_entry__ as entry
from oracle import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

#: slow queries without SQL that have their own tests
OWN_TESTS = {"log_resp_vb", "log_resp_em", "discriminative_em", "topic_label_model", "topic_then_label", "topic_schedule"}


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in OWN_TESTS])
def test_query(spark, sf, duck, name):
    result = QUERIES[name](spark, sf)
    if name in ORACLES:
        problem = compare(result, duck, ORACLES[name])
        assert problem is None, problem
    else:
        assert result.columns and result.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

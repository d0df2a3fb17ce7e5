"""Every query against its SQL on the smallest tables."""

import pytest

import millrace.operators  # noqa: F401
import millrace.sources.landing  # noqa: F401
import millrace.sources.sinks  # noqa: F401
import millrace.streaming.runs  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES
from tests.compare import same_as_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    same_as_sql(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

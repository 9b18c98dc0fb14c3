import pytest

import __spark_entry__
from communa.storage import release, tables_of
from tests.test_storage import SF, held

NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_queries_leave_what_they_read(spark, name):
    """A query leaves those tables alone that its result reads; of op11_filters one that an RDD reads."""
    before = held(spark)
    found = __spark_entry__.queries()[name](spark, SF)
    left = held(spark) - before
    assert len(left - tables_of(found)) == (name == "op11_filters") and tables_of(found) <= left
    found.collect()
    release(found, spark)

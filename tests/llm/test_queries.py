import pytest

from loomwork.llm.queries import registry
from tests.oracle import SF, oracle, result


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query(spark, name):
    cols, got = result(registry.queries[name](spark, SF))
    assert len(cols) == len(set(cols))
    if name in registry.sql:
        assert (cols, got) == oracle(registry.sql[name])

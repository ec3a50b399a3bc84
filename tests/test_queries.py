import pytest

from loomwork.queries import matching, problems, reports, snapshots
from tests.oracle import SF, oracle, result

REGISTRIES = (problems.registry, matching.registry, snapshots.registry, reports.registry)
QUERIES = {k: q for r in REGISTRIES for k, q in r.queries.items()}
SQL = {k: q for r in REGISTRIES for k, q in r.sql.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, got = result(QUERIES[name](spark, SF))
    assert len(cols) == len(set(cols))
    if name in SQL:
        assert (cols, got) == oracle(SQL[name])

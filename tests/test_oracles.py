import pytest

from fieldglass.plans import problems, reports, scoring, sequences
from tests.compare import canonical, oracle

QUERIES = {n: (f, m.ORACLES.get(n)) for m in (problems, scoring, reports, sequences) for n, f in m.QUERIES.items()}

#: Queries that SQL cannot express, with the test that checks them.
PROPERTIES = {
    "full_analysis": "test_analysis.py: against the scenes it was made from",
    "tracked_detections": "test_checks.py: against a plain fold",
    "merged_track_lines": "test_checks.py: no two near, none lost, families by angle",
    "side_ellipses": "test_checks.py: against the conic through numpy's least singular vector",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, sf, name):
    query, sql = QUERIES[name]
    got = query(spark, sf).toPandas()
    if sql is None:  # named here, and checked by a test of its own
        assert name in PROPERTIES and len(got)
        return
    want = oracle(sf, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)

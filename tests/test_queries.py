"""Registered queries against their reference SQL on the smallest tables. Set VIDIMUS_ALL=1 to run every
query; by default one or two of each group run."""
import os

import pytest

SF = "/root/testdata/sf0.001"
FEW = (
    "log_scan", "refusal_streaks", "projected_nodes", "independent_support", "citable_spans", "phrase_search", "cross_references",
    "attribution_verdicts", "nearest_windows", "copy_coverage", "stream_refusals",
)


def _names():
    import __spark_entry__ as entry

    return list(entry.queries()) if os.environ.get("VIDIMUS_ALL") else FEW


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", _names())
def test_query_agrees_with_sql(spark, name):
    from compare import check, connect

    import __spark_entry__ as entry

    ok, message = check(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

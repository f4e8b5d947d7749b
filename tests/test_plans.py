"""Plan properties that matter at scale, checked on the physical plans
(auto-broadcast off, as for large inputs)."""

import re

import pytest

from helpers import SF_SMALL
from matchbook.plans import catalog
from matchbook.plans.configs import o2m_pass, o2o_pass
from matchbook.plans.run import pass_members


def plan(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_nested_loop_or_cartesian_joins(no_broadcast):
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        p = plan(fn(no_broadcast, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_one_to_one_plan(no_broadcast):
    p = plan(pass_members(catalog.ledger(no_broadcast, SF_SMALL), o2o_pass()))
    # population filters reach the scan; the join is a shuffled equi-join
    assert "EqualTo(LS_TYPE,GL)" in p and "EqualTo(LS_TYPE,STMT)" in p
    assert "SortMergeJoin" in p
    # both best-candidate steps keep only the local top row before shuffling
    assert p.count("WindowGroupLimit") >= 4 and "Partial" in p


def test_one_to_many_plan_prunes_and_pre_aggregates(no_broadcast):
    p = plan(pass_members(catalog.ledger(no_broadcast, SF_SMALL), o2m_pass()))
    assert "partial_sum" in p and "partial_count" in p
    # the bucket aggregate reads no REFERENCE column
    agg_scans = [l for l in p.split("\n") if "FileScan parquet" in l and "REFERENCE" not in l]
    assert agg_scans


def test_hot_account_pass_joins_on_bins(no_broadcast):
    p = plan(pass_members(catalog.hot_ledger(no_broadcast, SF_SMALL), catalog.HOT_PASS))
    assert re.search(r"SortMergeJoin \[l_k0, l_k1, l_bin1, l_bin2\]", p)

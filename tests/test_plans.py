"""Plan shape: no Python on the batch path, pruning and pushdown reach the
scan, one full-row exchange for the flow state."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    from wirelens.sources.events import packets
    return packets(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_plan_has_no_python(spark, raw):
    from wirelens.plans.analyze import analyze
    from wirelens.plans.catalog import standard_rules
    a = analyze(raw, standard_rules(spark))
    for df in (a.totals, a.apps, a.hosts, a.flows, a.report):
        p = plan(df)
        assert "Python" not in p and "ArrowEval" not in p


def test_flow_key_filter_reaches_scan(spark, raw):
    from wirelens.operators.verdicts import packet_hosts
    h = packet_hosts(raw).filter("capture_id = 'events'").select("seq", "host")
    p = h._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(capture_id), EqualTo(capture_id,events)]" in p
    assert "ReadSchema: struct<capture_id:string,seq:bigint,data:binary>" in p


def test_flow_state_moves_packets_once(spark, raw):
    """One exchange of the packets and no checkpoint; with cut flows, besides
    the broadcast borders, only exchanges of one row per piece."""
    from wirelens.operators.flows import with_flow_state
    from wirelens.operators.verdicts import packet_hosts
    p = plan(with_flow_state(packet_hosts(raw)))
    assert p.count("Exchange") == 1 and "ExistingRDD" not in p and "Join" not in p
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(with_flow_state(packet_hosts(raw), piece_rows=3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ExistingRDD" not in p
    # above the merge join nothing moves; below it the packets once, the others are of one row per piece
    assert "Exchange" not in p.split("SortMergeJoin")[0]
    assert p.count("Exchange hashpartitioning") == 4 and p.count("Exchange hashpartitioning", p.index("SortAggregate")) <= 2 and p.count("BroadcastExchange") == 2


def test_entry_runs(spark):
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as se
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_packets == 1000
    assert set(se.oracle_sql()) <= set(se.queries())

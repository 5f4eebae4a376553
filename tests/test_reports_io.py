"""Report files (S4, S5), many captures in one job (E2), streaming TTL (T5)."""

import glob
import json
import os

import pytest

from frames import raw_df
from test_generator_fixture import ten_packets

from wirelens.operators import report as R
from wirelens.operators.rules import validate_rules
from wirelens.plans.analyze import analyze
from wirelens.schemas import RULES


def _text(path):
    files = sorted(glob.glob(os.path.join(path, "capture_id=*", "part-*")))
    return "".join(open(f).read() for f in files)


def test_json_and_csv_files(spark, tmpdir_path):
    a = analyze(raw_df(spark, ten_packets(), capture_id="gen"))
    jpath, cpath = os.path.join(tmpdir_path, "json"), os.path.join(tmpdir_path, "csv")
    R.write_report_json(R.report_json_lines(a.totals, a.apps, a.hosts, 45), jpath)
    R.write_report_csv(R.report_csv_lines(a.totals, a.apps, a.hosts, 45), cpath)
    text = _text(jpath)
    doc = json.loads(text)
    assert list(doc) == ["totalPackets", "totalBytes", "tcpPackets", "udpPackets", "forwarded",
                         "dropped", "processingTimeMs", "appBreakdown", "detectedSnis"]
    assert doc["totalBytes"] == 820 and doc["processingTimeMs"] == 45
    assert doc["appBreakdown"] == [{"appType": "UNKNOWN", "count": 10, "percentage": 100.0,
                                    "blocked": False, "bar": "#" * 20}]
    assert doc["detectedSnis"] == [{"sni": "example.com", "appType": "UNKNOWN"}]
    assert '  "totalPackets" : 10,\n' in text and '  "appBreakdown" : [ {\n' in text
    csv = _text(cpath).splitlines()
    assert csv[:2] == ["Metric,Value", "Total Packets,10"]
    assert csv[7:] == ["Processing Time (ms),45", "", "Application,Count,Percentage,Blocked",
                       "UNKNOWN,10,100.0,false", "", "SNI,Application", "example.com,UNKNOWN"]


def test_many_captures_with_per_capture_rules(spark):
    raw = raw_df(spark, ten_packets(), "a").unionByName(raw_df(spark, ten_packets(), "b"))
    rules, _ = validate_rules(spark.createDataFrame(
        [("domain", "example", "a"), ("ip", "8.8.8.8", "b")], RULES))
    got = {r.capture_id: (r.total_packets, r.dropped) for r in analyze(raw, rules).totals.collect()}
    assert got == {"a": (10, 1), "b": (10, 1)}
    flows = analyze(raw, rules).flows
    assert flows.count() == 20      # flows never span captures


def test_stream_verdicts_with_ttl_equal_batch(spark, tmpdir_path):
    from wirelens.operators.verdicts import packet_hosts, verdicts
    from wirelens.streaming.aggregates import read_packet_table_stream, run_to_table
    from wirelens.streaming.state import stream_states
    raw = raw_df(spark, ten_packets() * 3, capture_id="s")
    drop = os.path.join(tmpdir_path, "drop")
    raw.coalesce(1).write.parquet(drop)
    st = stream_states(packet_hosts(read_packet_table_stream(spark, drop)), ttl_ms=3_600_000)
    out = run_to_table(st.filter("is_parsed").select("seq", "app_state", "host_state", "flow_packets"), mode="append")
    got = {tuple(r) for r in spark.read.parquet(out).select(
        "seq", "app_state", "host_state", "flow_packets").collect()}
    want = {tuple(r) for r in verdicts(packet_hosts(raw)).filter("is_parsed").select(
        "seq", "app_state", "host_state", "flow_packets").collect()}
    assert got == want and len(got) == 30


def test_replayed_epochs_and_untouched_buckets(spark, tmpdir_path):
    """An epoch run again changes nothing; a bucket no row of an epoch falls
    in keeps its files; a crash before the manifest leaves nothing visible."""
    from pyspark.sql import functions as F

    from wirelens.streaming.aggregates import KeyedTable

    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    def rows(*some):
        return spark.createDataFrame(list(some), "k long, n long")
    t = KeyedTable(spark, os.path.join(tmpdir_path, "keyed"), ["k"], merge, buckets=8)
    assert t.read() is None
    t.upsert(rows((1, 1), (2, 5), (1, 2)), 0)
    t.upsert(rows((1, 10), (3, 7)), 1)
    want = [(1, 13), (2, 5), (3, 7)]
    assert sorted(map(tuple, t.read().collect())) == want
    before = t.manifest(1)
    t.upsert(rows((1, 10), (3, 7)), 1)
    assert t.manifest(1) == before and sorted(map(tuple, t.read().collect())) == want
    assert len(set(before["buckets"].values()) - set(t.manifest(0)["buckets"].values())) <= 2
    publish, t.publish = t.publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        t.upsert(rows((2, 100)), 2)
    assert sorted(map(tuple, t.read().collect())) == want
    t.publish = publish
    t.upsert(rows((2, 100)), 2)
    assert sorted(map(tuple, t.read().collect())) == [(1, 13), (2, 105), (3, 7)]

"""Capture files of a stream, and the report of one aggregate."""

import os

import pytest
from frames import frame, raw_df
from pyspark.sql import functions as F

from wirelens.operators import report as R
from wirelens.operators.flows import with_flow_state
from wirelens.operators.verdicts import packet_hosts, split_packets, verdicts
from wirelens.plans.catalog import standard_rules
from wirelens.sources.events import packets
from wirelens.streaming import forward
from wirelens.streaming.forward import CaptureLog, forward_stream

SF = "/root/testdata/sf0.001"


def some(n, first=0):
    return [frame("10.0.0.1", "10.0.0.2", 1000 + first + i, 80, payload=b"x" * (first + i)) for i in range(n)]


def test_stream_forward_equals_batch_bytes(spark, tmpdir_path):
    raw = packets(spark, SF, "single")
    rules = standard_rules(spark)
    src = os.path.join(tmpdir_path, "src")
    n = raw.count()
    place = F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(n // 2))
    for i in range(3):
        part = raw.withColumn("p", F.least(F.floor(place * 3 / n), F.lit(2))).filter(f"p = {i}").drop("p")
        part.coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    logs = forward_stream(stream, rules)
    want = split_packets(raw, verdicts(packet_hosts(raw), rules))
    for log, batch in zip(logs, want):
        got = [tuple(r) for r in log.read().orderBy("epoch", "seq").select("ts_sec", "ts_usec", "data").collect()]
        assert got == [tuple(r) for r in batch.orderBy("seq").select("ts_sec", "ts_usec", "data").collect()] and got


def test_only_published_epochs_are_seen(spark, tmpdir_path, monkeypatch):
    log = CaptureLog(spark, os.path.join(tmpdir_path, "log"))
    assert log.read() is None
    log.put(raw_df(spark, some(3), capture_id="c"), 0)
    log.put(raw_df(spark, [], capture_id="c"), 1)
    with monkeypatch.context() as m:  # dies behind the files of its epoch, before the manifest
        m.setattr(CaptureLog, "publish", lambda *a: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(OSError):
            log.put(raw_df(spark, some(4, 10), capture_id="c"), 2)
    assert os.listdir(os.path.join(log.path, "epoch-2")) and log.read().count() == 3
    log.put(raw_df(spark, some(2, 20), capture_id="c"), 2)  # runs again
    log.put(raw_df(spark, some(9), capture_id="c"), 0)  # behind its manifest: nothing
    got = log.read().orderBy("epoch", "seq").collect()
    assert [bytes(r.data) for r in got] == some(3) + some(2, 20) and [e for e, _ in log.folders()] == [0, 2]
    assert forward.CaptureLog(spark, log.path).read().count() == 5


def test_sections_equal_the_separate_aggregates(spark):
    raw = packets(spark, SF, "daily")
    rules = standard_rules(spark)
    seg = R.judged(R.segments(with_flow_state(packet_hosts(raw))), rules).cache()
    one = R.report_sections(seg)

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)

    total = one.filter("section = 'total'").select("capture_id", "packets", "bytes", "tcp_packets", "udp_packets", "forwarded", "dropped")
    assert rows(total) == rows(R.traffic_totals(seg))
    apps = one.filter("section = 'app'").select("capture_id", "app", F.col("packets").alias("count"))
    assert rows(apps) == rows(R.app_breakdown(seg, rules).select("capture_id", "app", "count"))
    hosts = one.filter("section = 'host'").select("capture_id", "host", "app", "first_seq")
    assert rows(hosts) == rows(R.detected_hosts(seg).select("capture_id", "host", "app", "first_seq")) and hosts.count() > 0
    seg.unpersist()


def test_sections_are_one_aggregate(spark):
    st = with_flow_state(packet_hosts(packets(spark, SF, "single")))
    seg = R.judged(R.segments(st), None).checkpoint(eager=True)
    plan = R.report_sections(seg)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1 and plan.count("Scan") == 1


def test_sections_of_nothing(spark):
    st = with_flow_state(packet_hosts(packets(spark, SF, "single").limit(0)))
    assert R.report_sections(R.judged(R.segments(st), None)).count() == 0

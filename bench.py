"""Benchmark of the headline queries.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line. Setup (deriving the packet
frames from ``events`` and writing them as Parquet and capture files) is
timed separately and not part of the metric. Each query runs once to warm
up and once timed; results are consumed by a no-op write or a collect of
the (small) report.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wirelens.session import local_session

    ncpu = os.cpu_count() if cpus == "*" else int(cpus)
    spark = local_session(cpus, shuffle_partitions=max(4, 2 * ncpu), memory="8g")

    from pyspark.sql import functions as F

    from wirelens.operators.flows import flow_table
    from wirelens.operators.verdicts import packet_hosts, verdicts
    from wirelens.plans import io_queries
    from wirelens.plans.analyze import analyze
    from wirelens.plans.catalog import standard_rules
    from wirelens.session import scratch_path
    from wirelens.sources.events import packets
    from wirelens.sources.pcap import read_pcap, write_pcap

    t0 = time.time()
    raw = packets(spark, sf_dir, "single")
    n_packets = raw.count()
    pcap_dir = io_queries.capture_folder(spark, sf_dir, "daily")
    setup = time.time() - t0
    rules = standard_rules(spark)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def q_decode():
        noop(packet_hosts(raw))

    def q_verdicts():
        noop(verdicts(packet_hosts(raw), rules))

    def q_report_packet():
        a = analyze(raw, rules, mode="packet")
        a.report.collect()
        a.hosts.count()

    def q_report_flow():
        a = analyze(raw, rules, mode="flow")
        a.report.collect()
        a.hosts.count()

    def q_flow_table():
        noop(flow_table(packet_hosts(raw)))

    def q_pcap_scan():
        h = packet_hosts(read_pcap(spark, pcap_dir))
        h.groupBy("capture_id").agg(F.count(F.lit(1)), F.sum("packet_bytes")).collect()

    def q_forward_pcap():
        a = analyze(raw, rules, keep_data=True)
        write_pcap(a.forwarded, scratch_path(spark, "bench-forwarded"))

    plan = [("decode_inspect", q_decode), ("verdicts", q_verdicts),
            ("report_packet_mode", q_report_packet), ("report_flow_mode", q_report_flow),
            ("flow_table", q_flow_table), ("pcap_scan", q_pcap_scan),
            ("forward_to_pcap", q_forward_pcap)]
    for _, fn in plan:          # warm-up (JIT, codegen caches)
        fn()
    times = {}
    for name, fn in plan:
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    pps = {k: round(n_packets / v) for k, v in times.items() if v > 0}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "packets": n_packets, "packets_per_sec": pps, "setup_sec": round(setup, 3),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Registered queries for capture files and streams.

Their inputs are written by Spark from the derived packets of ``events``
into the shared checkpoint folder: capture files through the ``pcap``
sink, and a drop folder of packet files for the streams.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import validate_rules
from ..operators.verdicts import packet_hosts
from ..plans.analyze import analyze
from ..schemas import FLOW_KEY, RAW_PACKETS
from ..session import scratch_path
from ..sources.events import load_events, packets, packets_from_events
from ..sources.inventory import capture_files, capture_inventory
from ..sources.pcap import read_pcap, write_pcap
from ..sources.ranges import read_pcap_errors
from ..streaming.aggregates import (KeyedTable, merge_flows, merge_totals, read_capture_stream,
                                    read_packet_table_stream, run_to_table, stream_flow_evictions, stream_flow_table)
from ..streaming.forward import forward_stream
from ..streaming.reorder import run_in_order
from ..streaming.state import stream_states, verdict_batch
from ..streaming.tail import CaptureTail

c = F.col
_paths: dict = {}

# Rows per file of the streaming drop folder.
STREAM_FILE_ROWS = 25_000
# A micro-batch takes so many packets at most, and a quarter of the files at
# most (``stream_batch_files``).
STREAM_BATCH_ROWS = 1_000_000
# One second in so many has its records damaged in the copies for pcap_permissive.
DAMAGED = 61
# Times that the captures of stream_tail grow.
TAIL_STEPS = 3
# Event time without a packet after which stream_flow_evictions evicts a flow.
EVICT_DAYS = 2


def _once(spark: SparkSession, sf: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _paths:
        _paths[key] = build()
    return _paths[key]


def capture_folder(spark: SparkSession, sf: str, layout: str = "daily") -> str:
    """Derived packets written as capture files (``<capture>/part-N.pcap``)."""
    def build():
        path = scratch_path(spark, f"captures-{layout}")
        write_pcap(packets(spark, sf, layout), path)
        return path
    return _once(spark, sf, f"pcap-{layout}", build)


def stream_folder(spark: SparkSession, sf: str, shuffled: bool = False) -> str:
    """Derived packets (one capture) as a drop folder of Parquet files, one
    file per consecutive ``seq`` range, so the file stream replays the capture
    in arrival order. One job writes all of it; the files' times, by which the
    stream orders them, follow their numbers. ``shuffled``: each packet comes
    later than its place by up to the length of two files. As in ``packets``,
    events are dealt and not frames, which are built once, where they are written."""
    def build():
        path = scratch_path(spark, "stream-drop")
        events = load_events(spark, sf)
        n = events.count()
        chunks = max(4, -(-n // STREAM_FILE_ROWS))
        seq = c("event_id").cast("bigint")
        place = seq + F.pmod(F.xxhash64(seq), F.lit(max(1, 2 * n // chunks))) if shuffled else seq
        packets_from_events(events.repartitionByRange(chunks, place).sortWithinPartitions(place)).write.parquet(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        parts = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=str)
        now = int(time.time()) * 1000
        for k, f in enumerate(parts):
            fs.setTimes(f, now + 1000 * (k - len(parts)), -1)
        return path
    return _once(spark, sf, f"stream-drop-{shuffled}", build)


def stream_batch_files(spark: SparkSession, path: str) -> int:
    """Files of a drop folder that a micro-batch admits. An epoch has fixed
    costs (commits of the state store, its jobs), so a stream of many small
    files takes several at once, up to ``STREAM_BATCH_ROWS`` packets."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(at))
    return max(1, min(n // 4, STREAM_BATCH_ROWS // STREAM_FILE_ROWS))


def stream_packets(spark: SparkSession, sf: str, shuffled: bool = False) -> DataFrame:
    """``stream_folder`` as a stream of raw packets."""
    path = stream_folder(spark, sf, shuffled)
    return read_packet_table_stream(spark, path, max_files=stream_batch_files(spark, path))


def q_pcap_scan(spark, sf):
    raw = read_pcap(spark, capture_folder(spark, sf, "daily"))
    h = packet_hosts(raw)
    return h.groupBy("capture_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_packets"),
        F.sum("packet_bytes").cast("bigint").alias("total_bytes"),
        F.count_if(c("is_parsed") & (c("protocol") == 6)).cast("bigint").alias("tcp_packets"),
        F.count_if(c("is_parsed") & (c("protocol") == 17)).cast("bigint").alias("udp_packets"))


def q_pcap_scan_split(spark, sf):
    """``pcap_scan`` by ranges so small that every file has many."""
    raw = read_pcap(spark, capture_folder(spark, sf, "single"), range_bytes=1 << 16)
    return raw.select("capture_id", c("ts_sec").cast("bigint").alias("ts_sec"), c("ts_usec").cast("bigint").alias("ts_usec"),
                      F.length("data").cast("bigint").alias("packet_bytes"),
                      (F.count(F.lit(1)).over(Window.partitionBy("capture_id", "seq"))).cast("bigint").alias("of_this_seq"))


def _damaged(batches):
    """Copies of capture files in which the records of some seconds say that
    they have a negative length."""
    import os
    import struct

    import pandas as pd

    for b in batches:
        for path, target in zip(b["path"], b["target"]):
            data = bytearray(open(path.removeprefix("file:"), "rb").read())
            pos = 24
            while pos + 16 <= len(data):
                sec, _usec, size, _whole = struct.unpack_from("<IIiI", data, pos)
                if sec % DAMAGED == 7:
                    struct.pack_into("<i", data, pos + 8, -1)
                pos += 16 + size
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(data)
        yield pd.DataFrame({"n": [len(b)]})


def damaged_folder(spark: SparkSession, sf: str) -> str:
    def build():
        path = scratch_path(spark, "captures-damaged")
        files = capture_files(spark, capture_folder(spark, sf, "daily")).select("path", F.concat(
            F.lit(path.removeprefix("file:") + "/"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).alias("target"))
        files.mapInPandas(_damaged, "n long").agg(F.sum("n")).collect()
        return path
    return _once(spark, sf, "pcap-damaged", build)


def q_pcap_permissive(spark, sf):
    """What is left of captures with damaged records, and the bytes passed over."""
    path = damaged_folder(spark, sf)
    kept = read_pcap(spark, path, mode="PERMISSIVE", range_bytes=1 << 16).groupBy("capture_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"), F.sum(F.length("data")).cast("bigint").alias("bytes"))
    lost = read_pcap_errors(spark, path, range_bytes=1 << 16).groupBy("capture_id").agg(F.sum("length").cast("bigint").alias("lost_bytes"))
    return kept.join(lost, "capture_id", "left").withColumn("lost_bytes", F.coalesce("lost_bytes", F.lit(0).cast("bigint")))


def _grown(share: float, whole: bool):
    """Copies of capture files grow to a share of the files' lengths, most of
    them up to the middle of a record."""
    def run(batches):
        import os

        import pandas as pd

        for b in batches:
            for path, target, length in zip(b["path"], b["target"], b["length"]):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                at = os.path.getsize(target) if os.path.exists(target) else 0
                end = length if whole else max(at, int(length * share))
                with open(path.removeprefix("file:"), "rb") as f, open(target, "ab") as out:
                    f.seek(at)
                    out.write(f.read(end - at))
            yield pd.DataFrame({"n": [len(b)]})
    return run


def q_stream_tail(spark, sf):
    """``pcap_scan_split`` of captures that grow while a stream reads them in
    epochs of a bounded size; the reader starts anew each time they grow."""
    captures, log = scratch_path(spark, "captures-growing"), scratch_path(spark, "tail")
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    files = capture_files(spark, capture_folder(spark, sf, "single")).withColumn("target", F.concat(
        F.lit(captures.removeprefix("file:") + "/"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)))
    size = files.agg(F.sum("length")).first()[0] or 0
    for k in range(1, TAIL_STEPS + 1):
        files.mapInPandas(_grown(k / TAIL_STEPS, k == TAIL_STEPS), "n long").agg(F.sum("n")).collect()
        tail = CaptureTail(spark, captures, log, max_bytes=max(1, size // (2 * TAIL_STEPS)), range_bytes=1 << 16)
        tail.drain()
        run_to_table(tail.stream(), out, mode="append", checkpoint=ckpt)
    raw = spark.read.schema(RAW_PACKETS).option("recursiveFileLookup", "true").parquet(out)
    return raw.select("capture_id", c("ts_sec").cast("bigint").alias("ts_sec"), c("ts_usec").cast("bigint").alias("ts_usec"),
                      F.length("data").cast("bigint").alias("packet_bytes"),
                      (F.count(F.lit(1)).over(Window.partitionBy("capture_id", "seq"))).cast("bigint").alias("of_this_seq"))


def q_pcap_roundtrip(spark, sf):
    from .catalog import standard_rules

    a = analyze(packets(spark, sf, "single"), standard_rules(spark), keep_data=True,
                processing_time_ms=0)
    out = scratch_path(spark, "forwarded")
    write_pcap(a.forwarded, out)
    back = read_pcap(spark, out)
    return back.select(c("ts_sec").cast("bigint").alias("ts_sec"),
                       c("ts_usec").cast("bigint").alias("ts_usec"),
                       c("incl_len").cast("bigint").alias("incl_len"),
                       c("orig_len").cast("bigint").alias("orig_len"))


def q_stream_ingest(spark, sf):
    stream = read_capture_stream(spark, capture_folder(spark, sf, "daily"), max_files=8)
    h = packet_hosts(stream).select("capture_id", "seq", "is_parsed", "packet_bytes")
    table = run_to_table(h, mode="append", trigger="drain")
    return spark.read.parquet(table).groupBy("capture_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"),
        F.sum("packet_bytes").cast("bigint").alias("bytes"),
        F.count_if(c("is_parsed")).cast("bigint").alias("parsed"))


def _packet_stream(spark, sf) -> DataFrame:
    return packet_hosts(stream_packets(spark, sf))


def q_stream_verdicts(spark, sf):
    from .catalog import standard_rules

    table = run_to_table(stream_states(_packet_stream(spark, sf)), mode="append",
                         per_batch=verdict_batch(standard_rules(spark)))
    return spark.read.parquet(table).select(c("seq").cast("bigint").alias("seq"), "is_parsed", "app_state",
                                            "host_state", "blocked", "block_reason")


def q_stream_verdicts_shuffled(spark, sf):
    """``stream_verdicts`` of packets that come out of order over micro-batches."""
    from .catalog import standard_rules

    stream = packet_hosts(stream_packets(spark, sf, shuffled=True))
    out = run_in_order(stream, standard_rules(spark))
    return spark.read.parquet(out).select(c("seq").cast("bigint").alias("seq"), "is_parsed", "app_state", "host_state",
                                          c("flow_packets").cast("bigint").alias("flow_packets"),
                                          c("flow_bytes").cast("bigint").alias("flow_bytes"), "blocked", "block_reason")


def q_stream_forward(spark, sf):
    """Captures of the packets that a stream out of order forwards and drops,
    read back with each packet's place in its capture."""
    from .catalog import standard_rules

    stream = stream_packets(spark, sf, shuffled=True)
    place = F.row_number().over(Window.partitionBy("dropped", "capture_id").orderBy("epoch", "seq"))
    parts = [log.read() for log in forward_stream(stream, standard_rules(spark))]
    both = [p.withColumn("dropped", F.lit(i == 1)) for i, p in enumerate(parts) if p is not None]
    if not both:
        both = [packets(spark, sf, "single").limit(0).selectExpr("0L AS epoch", "*", "false AS dropped")]
    out = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    return out.select("dropped", *[c(x).cast("bigint").alias(x) for x in ("ts_sec", "ts_usec", "incl_len", "orig_len")],
                      place.cast("bigint").alias("place"))


def q_stream_flow_evictions(spark, sf):
    """Flows evicted after ``EVICT_DAYS`` days without a packet."""
    f = stream_flow_evictions(_packet_stream(spark, sf), f"{EVICT_DAYS} days")
    table = run_to_table(f, mode="append", trigger="drain")
    return spark.read.parquet(table).select(
        "capture_id", *[c(x).cast("bigint").alias(x) for x in
                        ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "byte_count")], "app", "host",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


def q_stream_rules_large(spark, sf):
    """Verdicts of a stream by as many domain rules as there are events."""
    from .catalog import large_patterns

    t = large_patterns(spark, sf).filter(F.length("text") >= 4)
    rules, _ = validate_rules(t.select(F.lit("domain").alias("rule_type"), c("text").alias("value")))
    table = run_to_table(stream_states(_packet_stream(spark, sf)), mode="append", per_batch=verdict_batch(rules))
    return spark.read.parquet(table).select(c("seq").cast("bigint").alias("seq"), "host_state", "blocked")


def _merged_verdicts(spark, sf, keys, merge) -> DataFrame:
    from .catalog import standard_rules

    table = KeyedTable(spark, scratch_path(spark, "keyed"), keys, merge)
    run_to_table(stream_states(_packet_stream(spark, sf)), mode="append",
                 per_batch=verdict_batch(standard_rules(spark)), into=table.upsert)
    return table.read()


def q_stream_flow_upsert(spark, sf):
    return _merged_verdicts(spark, sf, FLOW_KEY, merge_flows).select(
        "capture_id", *[c(x).cast("bigint").alias(x) for x in
                        ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count",
                         "byte_count")], "app", "host", "blocked")


def q_stream_flow_table(spark, sf):
    f = stream_flow_table(_packet_stream(spark, sf))
    table = run_to_table(f, mode="complete")
    return spark.read.parquet(table).select(
        "capture_id", *[c(x).cast("bigint").alias(x) for x in
                        ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count",
                         "byte_count")], "app", "host")


def q_stream_totals(spark, sf):
    return _merged_verdicts(spark, sf, ["capture_id"], merge_totals)


def q_capture_inventory(spark, sf):
    """Inventory of the written capture files, summed per capture folder
    (file paths and part counts are run-specific, the sums are not)."""
    inv = capture_inventory(spark, capture_folder(spark, sf, "daily"))
    cap = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return inv.groupBy(cap.alias("capture_id"), "byte_order", "version", "snaplen", "link_type").agg(
        F.sum("n_packets").cast("bigint").alias("n_packets"),
        F.sum("n_bytes").cast("bigint").alias("n_bytes"),
        F.count_if(c("error").isNotNull()).cast("bigint").alias("errors"))


def queries():
    return {
        "pcap_scan": q_pcap_scan,
        "pcap_scan_split": q_pcap_scan_split,
        "pcap_permissive": q_pcap_permissive,
        "pcap_roundtrip": q_pcap_roundtrip,
        "stream_ingest": q_stream_ingest,
        "stream_tail": q_stream_tail,
        "stream_verdicts": q_stream_verdicts,
        "stream_verdicts_shuffled": q_stream_verdicts_shuffled,
        "stream_forward": q_stream_forward,
        "stream_flow_evictions": q_stream_flow_evictions,
        "stream_flow_table": q_stream_flow_table,
        "stream_flow_upsert": q_stream_flow_upsert,
        "stream_rules_large": q_stream_rules_large,
        "stream_totals": q_stream_totals,
        "capture_inventory": q_capture_inventory,
    }


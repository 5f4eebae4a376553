"""Per-packet verdicts and the forwarded / dropped streams.

``packet_hosts`` is the projection every later step needs; it drops the
frame bytes unless asked to keep them, so the flow-state shuffle moves a
few dozen bytes per packet instead of the whole frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import classify_hosts
from .decode import decode_packets, to_raw
from .flows import DEFAULT_PIECE_ROWS, with_flow_state
from .inspect import inspect_hosts
from .rules import apply_rules

HOST_COLUMNS = [
    "capture_id", "seq", "ts_sec", "ts_usec", "is_parsed", "protocol",
    "src_ip", "dst_ip", "src_port", "dst_port", "svc_port", "packet_bytes",
    "sni", "http_host", "host", "named", "port_app",
]


def packet_hosts(raw: DataFrame, port_mode: str = "normalized", keywords=None,
                 keep_data: bool = False) -> DataFrame:
    """Decode -> inspect -> classify, projected to ``HOST_COLUMNS``."""
    df = decode_packets(raw, port_mode=port_mode)
    df = df.withColumn("packet_bytes", F.length("data").cast("int"))
    df = inspect_hosts(df)
    df = classify_hosts(df, keywords)
    cols = HOST_COLUMNS + (["data"] if keep_data else [])
    return df.select(*cols)


def verdicts(hosts: DataFrame, rules: DataFrame | None = None, ip_match: str = "low_endpoint",
             piece_rows: int = DEFAULT_PIECE_ROWS, partitions: int | None = None) -> DataFrame:
    """Per-packet state and verdict: ``packet_hosts`` + ``app_state``,
    ``host_state``, ``flow_packets``, ``flow_bytes``, ``blocked``,
    ``block_reason``. Unparsed packets are never blocked.

    State is updated before the rules are checked, and blocked packets
    still update their flow, so rules are applied after the state scan. A
    flow's last host is a host of its packets, so domain rules are resolved
    on the distinct hosts of ``hosts``, before the packets are moved.
    """
    st = with_flow_state(hosts, piece_rows=piece_rows, partitions=partitions)
    v = apply_rules(st, rules, ip_match=ip_match, hosts=hosts)
    return v.withColumn("blocked", F.coalesce(F.col("blocked") & F.col("is_parsed"), F.lit(False)))


def forwarded_packets(v: DataFrame) -> DataFrame:
    """Unparsed packets and allowed packets, as raw packets."""
    return to_raw(v.filter(~F.col("blocked")))


def dropped_packets(v: DataFrame) -> DataFrame:
    """Blocked packets."""
    return to_raw(v.filter(F.col("blocked")))


def split_packets(raw: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(forwarded, dropped)`` raw packets by the verdicts ``v`` on them
    (U1, U2), joined on (capture, seq). The verdicts are computed without
    frame bytes, which so move in this join alone, or not at all where the
    dropped keys are few enough for Spark to broadcast."""
    key = ["capture_id", "seq"]
    blocked = v.filter(F.col("blocked")).select(*key)
    return to_raw(raw.join(blocked, key, "left_anti")), to_raw(raw.join(blocked, key, "left_semi"))

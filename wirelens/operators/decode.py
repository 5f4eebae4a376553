"""Packet decoding as Catalyst expressions.

``decode_packets`` adds the Ethernet/IPv4/TCP/UDP header fields to a
``raw_packets`` DataFrame in one narrow projection: no shuffle, no Python,
and filters on the decoded columns still reach the scan for the columns
they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import cached_column, u8, u16, u32
from ..functions.ip import flow_label as _flow_label

ETHERTYPE_IPV4 = 0x0800
TCP, UDP = 6, 17


def _decode_stages() -> list[dict[str, Column]]:
    """The decoder's projections, each reading columns of the one before."""
    c = F.col
    data = c("data")
    stages = [{
        "__n": F.length(data),
        "__eth": u16(data, 12),
        "ip_header_len": (u8(data, 14).bitwiseAND(0x0F) * 4).cast("int"),
        "__proto": u8(data, 23).cast("int"),
    }, {"__t": c("ip_header_len") + 14}]
    stages.append({"__tcp_hlen": F.when(
        c("__proto") == TCP,
        (F.shiftright(u8(data, c("__t") + 12), 4).bitwiseAND(0x0F) * 4).cast("int"))})
    n, t, th = c("__n"), c("__t"), c("__tcp_hlen")
    l4_ok = (F.when(c("__proto") == TCP, (n >= t + 20) & (th >= 20) & (n >= t + th))
             .when(c("__proto") == UDP, n >= t + 8)
             .otherwise(F.lit(False)))
    stages.append({"is_parsed": F.coalesce(
        (n >= 14) & (c("__eth") == ETHERTYPE_IPV4) & (n >= 34)
        & (c("ip_header_len") >= 20) & (n >= c("ip_header_len") + 14) & l4_ok,
        F.lit(False))})
    p = c("is_parsed")
    l4_hlen = F.when(c("__proto") == TCP, th).otherwise(F.lit(8))
    stages.append({
        "ip_header_len": F.when(p, c("ip_header_len")),
        "l4_header_len": F.when(p, l4_hlen).cast("int"),
        "protocol": F.when(p, c("__proto")).cast("smallint"),
        "wire_src_ip": F.when(p, u32(data, 26)),
        "wire_dst_ip": F.when(p, u32(data, 30)),
        "wire_src_port": F.when(p, u16(data, t)).cast("int"),
        "wire_dst_port": F.when(p, u16(data, t + 2)).cast("int"),
        "payload_offset": F.when(p, t + l4_hlen).cast("int"),
    })
    stages.append({"payload_len": F.when(
        p, F.greatest(F.lit(0), n - c("payload_offset"))).cast("int")})
    return stages


def decode_packets(raw: DataFrame, port_mode: str = "normalized") -> DataFrame:
    """``raw_packets`` -> ``parsed_packets`` (FIXTURES §1).

    Header fields are NULL on unparsed rows. ``src_*``/``dst_*`` are the
    direction-normalised flow key (lower address first, then lower port);
    the ``wire_*`` columns keep the on-the-wire direction. ``svc_port`` is the
    port used for the TLS gate and the port fallback class: the normalised
    ``dst_port`` (``port_mode="normalized"``, exact to the reference) or the
    well-known service port of either end (``port_mode="service"``).

    Offsets are computed in successive projections, each reading earlier
    columns, so the expression tree stays linear in size.
    """
    stages = cached_column("decode_stages", _decode_stages)
    df = raw
    for cols in stages:
        df = df.withColumns(cols)
    df = df.drop("__n", "__eth", "__proto", "__t", "__tcp_hlen")
    return with_flow_key(df, port_mode=port_mode)


def with_flow_key(df: DataFrame, port_mode: str = "normalized") -> DataFrame:
    """Direction-normalised 5-tuple (P5) plus ``svc_port``.

    Swap when the source address is numerically (unsigned) above the
    destination, or the addresses are equal and the source port is higher.
    """
    c = F.col
    swap = (c("wire_src_ip") > c("wire_dst_ip")) | (
        (c("wire_src_ip") == c("wire_dst_ip")) & (c("wire_src_port") > c("wire_dst_port")))
    df = df.select(
        "*",
        F.when(swap, c("wire_dst_ip")).otherwise(c("wire_src_ip")).alias("src_ip"),
        F.when(swap, c("wire_src_ip")).otherwise(c("wire_dst_ip")).alias("dst_ip"),
        F.when(swap, c("wire_dst_port")).otherwise(c("wire_src_port")).alias("src_port"),
        F.when(swap, c("wire_src_port")).otherwise(c("wire_dst_port")).alias("dst_port"),
    )
    if port_mode == "normalized":
        svc = c("dst_port")
    elif port_mode == "service":
        either = lambda p: (c("src_port") == p) | (c("dst_port") == p)
        svc = (F.when(either(443), F.lit(443)).when(either(80), F.lit(80))
               .when(either(53), F.lit(53)).otherwise(c("dst_port")))
    else:
        raise ValueError(f"port_mode must be 'normalized' or 'service', not {port_mode!r}")
    return df.withColumn("svc_port", svc.cast("int"))


def flow_label() -> Column:
    """``a.b.c.d:p <-> e.f.g.h:q proto=n`` of a decoded row's flow key."""
    return _flow_label("src_ip", "src_port", "dst_ip", "dst_port", "protocol")


def payload() -> Column:
    """The payload bytes (BINARY) of a decoded row."""
    return F.substring(F.col("data"), F.col("payload_offset") + 1, F.col("payload_len"))


def bypass_packets(parsed: DataFrame) -> DataFrame:
    """Rows the decoder could not parse (P10); they are always forwarded."""
    return parsed.filter(~F.col("is_parsed"))


def to_raw(df: DataFrame) -> DataFrame:
    """Back-projection to the raw packet columns."""
    return df.select("capture_id", "seq", "ts_sec", "ts_usec",
                     F.length("data").cast("int").alias("incl_len"),
                     F.length("data").cast("int").alias("orig_len"), "data")

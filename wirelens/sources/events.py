"""Raw packets derived from the ``events`` table.

The test tables hold no captures, so every registered query builds real
Ethernet/IPv4/TCP/UDP frame bytes from ``events`` rows with native column
expressions (one narrow projection, no shuffle), and the rest of the library
decodes those bytes like any capture. The expected values are computed
independently from the logical columns by the oracle SQL.

Logical packet per event (fixed layout of the test fixture):
  seq = event_id; client 192.168.1.0 + user_id; server 203.0.113.x for even
  users (above the client) or 142.250.80.x for odd users (below it);
  slot = event_id % 4 picks server port 443 / 80 / 53 (UDP) / 8080;
  ``error`` events travel server -> client; view/click events carry a host
  (TLS ClientHello on slot 0, HTTP GET otherwise); every 97th / 89th / 83rd
  event is ARP / ICMP / truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import be_hex

# --- fixed values of the test fixture -------------------------------------
CLIENT_BASE = 3232235776          # 192.168.1.0
SERVER_HIGH = 3405803776          # 203.0.113.0 (even user_id)
SERVER_LOW = 2398769152           # 142.250.80.0 (odd user_id)
CLIENT_PORT_BASE = 40000
SLOT_PORTS = [443, 80, 53, 8080]
HOSTS = [
    "www.youtube.com", "i.ytimg.com", "static.xx.fbcdn.net", "www.google.com",
    "pbs.twimg.com", "www.netflix.com", "v16.tiktokcdn.com", "github.com",
    "s3.amazonaws.com", "www.example.com", "", "WWW.GoogleVideo.com",
]
ETH_MACS = "001122334455" "66778899AABB"
# ---------------------------------------------------------------------------


def _text_hex(s: Column) -> Column:
    return F.hex(F.encode(s, "UTF-8"))


def logical_packets(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Logical columns of each derived packet (no bytes yet)."""
    e = events.select("event_id", "ts", "user_id", "event_type", *keep)
    slot = F.col("event_id") % 4
    kind = (F.when(F.col("event_id") % 97 == 0, "arp")
            .when(F.col("event_id") % 89 == 0, "icmp")
            .when(F.col("event_id") % 83 == 0, "trunc").otherwise("ok"))
    client_ip = F.lit(CLIENT_BASE) + F.col("user_id")
    server_ip = (F.when(F.col("user_id") % 2 == 0, F.lit(SERVER_HIGH))
                 .otherwise(F.lit(SERVER_LOW)) + slot)
    server_port = F.element_at(F.array(*[F.lit(p) for p in SLOT_PORTS]),
                               (slot + 1).cast("int"))
    hidx = ((F.col("event_id") * 7 + F.col("user_id") * 3) % 12 + 1).cast("int")
    host_sent = F.when(F.col("event_type").isin("view", "click"),
                       F.element_at(F.array(*[F.lit(h) for h in HOSTS]), hidx))
    reply = F.col("event_type") == "error"
    return (e.select(
        F.col("event_id").alias("seq"), "ts", "user_id", "event_type",
        slot.alias("slot"), kind.alias("kind"),
        client_ip.cast("bigint").alias("client_ip"),
        server_ip.cast("bigint").alias("server_ip"),
        (F.lit(CLIENT_PORT_BASE) + slot).cast("int").alias("client_port"),
        server_port.cast("int").alias("server_port"),
        F.when(slot == 2, F.lit(17)).otherwise(F.lit(6)).alias("l4"),
        host_sent.alias("host_sent"),
        reply.alias("reply"), *keep)
    )


def _tls_client_hello_hex(host: Column, extra_ext: Column) -> Column:
    """Hex of a minimal TLS ClientHello record carrying ``host`` as SNI."""
    nlen = F.octet_length(host)
    ext_len = F.when(extra_ext, F.lit(6)).otherwise(F.lit(0)) + 9 + nlen
    body_len = ext_len + 43
    return F.concat(
        F.lit("160301"), be_hex(body_len + 4, 2),        # record header
        F.lit("01"), be_hex(body_len, 3),                  # handshake header
        F.lit("0303"), F.lit("00" * 32),                   # version, random
        F.lit("00"),                                        # session id
        F.lit("00020000"),                                  # cipher suites
        F.lit("0100"),                                      # compression
        be_hex(ext_len, 2),
        F.when(extra_ext, F.lit("000B00020100")).otherwise(F.lit("")),
        F.lit("0000"), be_hex(nlen + 5, 2), be_hex(nlen + 3, 2),
        F.lit("00"), be_hex(nlen, 2), _text_hex(host),
    )


def packets_from_events(events: DataFrame, capture_id: Column | str = "events") -> DataFrame:
    """``raw_packets`` (schema ``RAW_PACKETS``) built from ``events``.

    ``capture_id`` may be a literal string or a Column over the events.
    """
    cap = F.lit(capture_id) if isinstance(capture_id, str) else capture_id
    lp = logical_packets(events.withColumn("__cap", cap), keep=("__cap",))
    c = F.col
    wire_src_ip = F.when(c("reply"), c("server_ip")).otherwise(c("client_ip"))
    wire_dst_ip = F.when(c("reply"), c("client_ip")).otherwise(c("server_ip"))
    wire_src_port = F.when(c("reply"), c("server_port")).otherwise(c("client_port"))
    wire_dst_port = F.when(c("reply"), c("client_port")).otherwise(c("server_port"))
    payload = (
        F.when(c("host_sent").isNotNull() & (c("slot") == 0),
               _tls_client_hello_hex(c("host_sent"), c("user_id") % 3 == 0))
        .when(c("host_sent").isNotNull(),
              _text_hex(F.concat(
                  F.lit("GET / HTTP/1.1\r\n"),
                  F.when(c("user_id") % 2 == 1, F.lit("host: ")).otherwise(F.lit("Host: ")),
                  c("host_sent"), F.lit("\r\n\r\n"))))
        .when(c("event_type") == "purchase",
              _text_hex(F.lit("POST /x HTTP/1.1\r\nX: y\r\n\r\n")))
        .when(c("event_type") == "signup", F.lit("010203"))
        .otherwise(F.lit("")))
    plen = F.length(payload) / 2
    l4 = F.when(
        c("l4") == 6,
        F.concat(be_hex(wire_src_port, 2), be_hex(wire_dst_port, 2),
                 F.lit("0000000000000000"), F.lit("5018"), F.lit("000000000000")),
    ).otherwise(
        F.concat(be_hex(wire_src_port, 2), be_hex(wire_dst_port, 2),
                 be_hex(plen + 8, 2), F.lit("0000")))
    ip = F.concat(
        F.lit("4500"), F.lit("0000"), be_hex(c("seq") % 65536, 2), F.lit("0000"),
        F.lit("40"), F.when(c("kind") == "icmp", F.lit("01")).otherwise(be_hex(c("l4"), 1)),
        F.lit("0000"), be_hex(wire_src_ip, 4), be_hex(wire_dst_ip, 4))
    eth = F.concat(F.lit(ETH_MACS),
                   F.when(c("kind") == "arp", F.lit("0806")).otherwise(F.lit("0800")))
    frame = F.unhex(F.concat(eth, ip, l4, payload))
    frame = F.when(c("kind") == "trunc", F.substring(frame, 1, 30)).otherwise(frame)
    # microseconds since the epoch of the (time-zone-less) event time
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    out = lp.select(
        c("__cap").cast("string").alias("capture_id"),
        c("seq").cast("bigint").alias("seq"),
        F.floor(micros / 1000000).cast("bigint").alias("ts_sec"),
        F.pmod(micros, F.lit(1000000)).cast("bigint").alias("ts_usec"),
        frame.alias("data"))
    return out.select(
        "capture_id", "seq", "ts_sec", "ts_usec",
        F.length("data").cast("int").alias("incl_len"),
        F.length("data").cast("int").alias("orig_len"),
        "data")


def load_events(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


# Capture layouts of the derived packets: one capture for the whole table,
# or one capture per calendar day of ``events.ts`` (many captures, E2).
CAPTURE_LAYOUTS = {
    "single": lambda: F.lit("events"),
    "daily": lambda: F.date_format(F.col("ts"), "yyyy-MM-dd"),
}

_materialized: dict = {}


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def packets(spark, sf_dir: str, layout: str = "single") -> DataFrame:
    """Derived ``raw_packets`` for one test-data directory.

    The frames are built once per session and written as a Parquet table
    under the shared checkpoint folder, then read back: downstream plans
    then start from a plain ``data`` column, as they would from ingested
    captures, instead of re-deriving the bytes inside every expression
    that reads them.
    """
    from ..session import scratch_path

    key = (sf_dir.rstrip("/"), layout, spark.sparkContext.applicationId)
    path = _materialized.get(key)
    if path is None or not _exists(spark, path):
        path = scratch_path(spark, f"derived-packets-{layout}")
        # many files in seq ranges, like a capture rotated into many files,
        # so scans split across all cores; events are dealt, not frames, which
        # the sampling of the ranges would build once more
        n = max(1, spark.sparkContext.defaultParallelism)
        events = load_events(spark, sf_dir).withColumn("__capture", CAPTURE_LAYOUTS[layout]()).repartitionByRange(n, "__capture", "event_id")
        packets_from_events(events, F.col("__capture")).write.mode("overwrite").parquet(path)
        _materialized[key] = path
    return spark.read.parquet(path)

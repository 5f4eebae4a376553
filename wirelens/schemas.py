"""Fixed table schemas. Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_PACKETS = T.StructType([
    T.StructField("capture_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts_sec", T.LongType(), True),
    T.StructField("ts_usec", T.LongType(), True),
    T.StructField("incl_len", T.IntegerType(), True),
    T.StructField("orig_len", T.IntegerType(), True),
    T.StructField("data", T.BinaryType(), True),
])

RAW_COLUMNS = [f.name for f in RAW_PACKETS.fields]

# Normalised flow key (the capture is part of it: flows never span captures).
FLOW_KEY = ["capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

RULES = T.StructType([
    T.StructField("rule_type", T.StringType(), False),   # ip | app | domain
    T.StructField("value", T.StringType(), True),
    T.StructField("capture_id", T.StringType(), True),   # NULL = every capture
])

APP_KEYWORDS = T.StructType([
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("app", T.StringType(), False),
])

CAPTURE_INVENTORY = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("byte_order", T.StringType(), True),
    T.StructField("version", T.StringType(), True),
    T.StructField("snaplen", T.LongType(), True),
    T.StructField("link_type", T.LongType(), True),
    T.StructField("n_packets", T.LongType(), True),
    T.StructField("n_bytes", T.LongType(), True),
    T.StructField("error", T.StringType(), True),
])

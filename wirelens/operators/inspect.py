"""Host extraction from payloads (X1 TLS SNI, X2 HTTP Host, X3 host).

Both extractors are native Catalyst expressions. The ClientHello is walked
with one ``aggregate`` over a bounded ``sequence``, and the walk sits inside
``when(gate, ...)`` so only ClientHello payloads pay for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import ascii_text, cached_column, let, slice_bytes, u8, u16, utf8_text

# --- fixed values ----------------------------------------------------------
HTTP_METHODS = ["GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS "]
HOST_MARKERS = ["\r\nHost: ", "\r\nhost: "]   # searched in this order
TLS_HANDSHAKE = 0x16
TLS_CLIENT_HELLO = 0x01
TLS_PORT = 443
SNI_EXTENSION = 0x0000
# ---------------------------------------------------------------------------


def sni_expr(data: Column, off: Column, length: Column, port: Column) -> Column:
    """Server name of a TLS ClientHello payload, or NULL.

    One ``aggregate`` over a bounded ``sequence`` runs a small state
    machine: phase 0 session id, 1 cipher suites, 2 compression methods,
    3 extensions length, 4 one extension per step, then 5 = done. Every
    length read is checked against the payload end (``lim`` = the end of
    the extension list once known). Each step advances at least one byte
    (four in the extension loop), so ``len/4 + 5`` steps always suffice.
    The expression reads only ``data``, ``off`` and ``length``, so it stays
    linear in size wherever the optimizer moves it.
    """
    end = (off + length).cast("bigint")
    gate = ((port == TLS_PORT) & (length >= 6)
            & (u8(data, off) == TLS_HANDSHAKE) & (u8(data, off + 5) == TLS_CLIENT_HELLO))
    # (callers bind off/length/port once with ``let``)
    steps = F.sequence(F.lit(1), (length / 4).cast("int") + 5)
    # body starts at off+9: version (2) and random (32) -> session id at off+43
    init = F.struct(F.lit(0).alias("phase"), (off + 43).cast("bigint").alias("pos"),
                    end.alias("lim"), F.lit(None).cast("string").alias("sni"))

    def st(phase, pos, lim, sni=None):
        return F.struct(F.lit(phase).alias("phase"), pos.cast("bigint").alias("pos"),
                        lim.cast("bigint").alias("lim"),
                        (sni if sni is not None else F.lit(None).cast("string")).alias("sni"))

    def step(acc, _i):
        ph, pos, lim = acc["phase"], acc["pos"], acc["lim"]
        done = st(5, pos, lim)
        after1 = pos + 1 + u8(data, pos)          # one length byte + body
        after2 = pos + 2 + u16(data, pos)         # two length bytes + body
        etype, elen = u16(data, pos), u16(data, pos + 2)
        body = pos + 4
        name_len = u16(data, body + 3)
        name_at = body + 5
        ext = (F.when(pos + 4 > lim, done)
               .when(body + elen > lim, done)
               .when(etype != SNI_EXTENSION, st(4, body + elen, lim))
               .when(elen < 5, done)
               .when(u8(data, body + 2) != 0, done)
               .when(name_at + name_len > lim, done)
               .otherwise(st(5, pos, lim, ascii_text(slice_bytes(data, name_at, name_len)))))
        return (
            F.when(ph == 5, acc)
            .when(ph == 0, F.when((pos + 1 > end) | (after1 > end), done).otherwise(st(1, after1, lim)))
            .when(ph == 1, F.when((pos + 2 > end) | (after2 > end), done).otherwise(st(2, after2, lim)))
            .when(ph == 2, F.when((pos + 1 > end) | (after1 > end), done).otherwise(st(3, after1, lim)))
            .when(ph == 3, F.when(pos + 2 > end, done)
                  .otherwise(st(4, pos + 2, F.least(end, after2))))
            .otherwise(ext))

    return F.when(F.coalesce(gate, F.lit(False)), F.aggregate(steps, init, step)["sni"])


def with_sni(df: DataFrame) -> DataFrame:
    """Adds ``sni``: the server name of a TLS ClientHello payload.

    Gate: port (``svc_port``) 443, payload of at least 6 bytes, record type
    0x16 and handshake type 0x01; the transport is not checked. Record and
    handshake lengths are not trusted and there is no reassembly.
    """
    return df.withColumn("sni", cached_column("sni", _sni_column))


def _sni_column() -> Column:
    c = F.col
    loc = F.struct(c("payload_offset").cast("bigint").alias("off"),
                   c("payload_len").cast("bigint").alias("len"), c("svc_port").alias("port"))
    return F.when(c("is_parsed") & (c("payload_len") >= 6) & (c("svc_port") == TLS_PORT),
                  let(loc, lambda s: sni_expr(c("data"), s["off"], s["len"], s["port"])))


_METHOD_RE = "^(" + "|".join(m.strip() for m in HTTP_METHODS) + ") "


def http_host_of_text(text: Column) -> Column:
    """Host value in decoded request text, or NULL (X2, after the gate)."""
    def at(i):
        rest = F.substring(text, i + 8, F.lit(1 << 30))
        value = F.substring_index(rest, "\r\n", 1)
        return F.regexp_replace(value, "^[\\x{00}-\\x{20}]+|[\\x{00}-\\x{20}]+\\z", "")
    i1, i2 = F.instr(text, HOST_MARKERS[0]), F.instr(text, HOST_MARKERS[1])
    idx = F.when(i1 > 0, i1).when(i2 > 0, i2)
    return let(idx, lambda i: F.when(i.isNotNull(), at(i)))


def with_http_host(df: DataFrame) -> DataFrame:
    """Adds ``http_host``: the Host header of an HTTP request payload.

    The payload must be at least 16 bytes and start with an upper-case
    method and a space. ``Host: `` is searched first, then ``host: ``; the
    value runs to the next CRLF (or the end) and is trimmed of characters
    <= U+0020 on both sides. It may be ''.
    """
    return df.withColumn("http_host", cached_column("http_host", _http_host_column))


def _http_host_column() -> Column:
    c = F.col

    def of_payload(p):
        is_req = F.decode(F.substring(p, 1, 8), "ISO-8859-1").rlike(_METHOD_RE)
        return F.when(is_req, let(utf8_text(p), http_host_of_text))

    payload = slice_bytes(c("data"), c("payload_offset"), c("payload_len"))
    return F.when(c("is_parsed") & (c("payload_len") >= 16), let(payload, of_payload))


def inspect_hosts(df: DataFrame) -> DataFrame:
    """Adds ``sni``, ``http_host`` and ``host`` = SNI, else HTTP host.

    An empty host ('') is a found host and is kept distinct from NULL.
    """
    return with_http_host(with_sni(df)).withColumn(
        "host", F.coalesce(F.col("sni"), F.col("http_host")))

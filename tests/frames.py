"""Hand-built frames for byte-level tests (plain Python, no Spark)."""

import struct


def ip(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def client_hello(name: bytes, extra_ext: bytes = b"", sni_ext: bytes | None = None) -> bytes:
    if sni_ext is None:
        sni_ext = (struct.pack(">HH", 0, len(name) + 5) + struct.pack(">H", len(name) + 3)
                   + b"\x00" + struct.pack(">H", len(name)) + name)
    exts = extra_ext + sni_ext
    body = (b"\x03\x03" + b"\x00" * 32 + b"\x00" + b"\x00\x02\x00\x00" + b"\x01\x00"
            + struct.pack(">H", len(exts)) + exts)
    hs = b"\x01" + struct.pack(">I", len(body))[1:] + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hs)) + hs


def frame(src: str, dst: str, sport: int, dport: int, proto: int = 6, payload: bytes = b"",
          ethertype: int = 0x0800, ihl: int = 5, tcp_off: int = 5, version: int = 4) -> bytes:
    eth = b"\x00\x11\x22\x33\x44\x55\x66\x77\x88\x99\xaa\xbb" + struct.pack(">H", ethertype)
    iph = (bytes([(version << 4) | ihl, 0]) + b"\x00\x00" + b"\x00\x01" + b"\x00\x00"
           + bytes([64, proto]) + b"\x00\x00" + struct.pack(">II", ip(src), ip(dst)))
    iph += b"\x00" * (ihl * 4 - 20) if ihl > 5 else b""
    if proto == 6:
        l4 = (struct.pack(">HH", sport, dport) + b"\x00" * 8 + bytes([tcp_off << 4, 0x18])
              + b"\x00" * 6 + b"\x00" * max(0, tcp_off * 4 - 20))
    elif proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    else:
        l4 = b"\x00" * 8
    return eth + iph + l4 + payload


def raw_df(spark, frames, capture_id="t"):
    from wirelens.schemas import RAW_PACKETS

    rows = [(capture_id, i, 1700000000 + i, i, len(f), len(f), bytearray(f))
            for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, RAW_PACKETS)

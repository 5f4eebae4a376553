"""Byte-level edge cases of decoding and host extraction (FIXTURES §4)."""

from frames import client_hello, frame, raw_df

from wirelens.operators.verdicts import packet_hosts


def run(spark, frames, **kw):
    rows = packet_hosts(raw_df(spark, frames), **kw).orderBy("seq").collect()
    return rows


def test_parse_gate(spark):
    good = frame("10.0.0.1", "10.0.0.2", 1000, 80)
    fs = [
        good[:13],                                        # too short
        frame("10.0.0.1", "10.0.0.2", 1, 2, ethertype=0x86DD),
        frame("10.0.0.1", "10.0.0.2", 1, 2, ethertype=0x8100),
        frame("10.0.0.1", "10.0.0.2", 1, 2, ethertype=0x0806),
        frame("10.0.0.1", "10.0.0.2", 1, 2, ihl=4),       # IHL*4 < 20
        frame("10.0.0.1", "10.0.0.2", 1, 2, ihl=15)[:40],  # header past the end
        frame("10.0.0.1", "10.0.0.2", 1, 2, ihl=6),       # options: parsed
        frame("10.0.0.1", "10.0.0.2", 1, 2, version=6),   # version not checked
        frame("10.0.0.1", "10.0.0.2", 1, 2, proto=1),     # ICMP
        frame("10.0.0.1", "10.0.0.2", 1, 2, tcp_off=4),   # data offset < 5
        good[:14 + 20 + 19],                              # 19 TCP bytes
        frame("10.0.0.1", "10.0.0.2", 1, 2, proto=17)[:14 + 20 + 7],
        good + b"\x00" * 6,                               # padding is payload
    ]
    rows = run(spark, fs)
    assert [r.is_parsed for r in rows] == [False, False, False, False, False, False, True, True,
                                          False, False, False, False, True]
    assert rows[6].src_port == 1 and rows[6].dst_port == 2   # ports after 4 option bytes
    assert rows[0].packet_bytes == 13


def test_flow_key_normalisation(spark):
    rows = run(spark, [
        frame("10.0.0.5", "10.0.0.5", 9000, 80),      # equal IPs, higher source port
        frame("200.0.0.1", "10.0.0.1", 1234, 443),    # unsigned order
        frame("10.0.0.1", "200.0.0.1", 1234, 443),
    ])
    assert (rows[0].src_port, rows[0].dst_port) == (80, 9000)
    assert rows[1].src_ip == (10 << 24) + 1 and rows[1].dst_port == 1234
    assert rows[2].src_ip == (10 << 24) + 1 and rows[2].dst_port == 443


def test_sni_cases(spark):
    c, s = "10.0.0.1", "20.0.0.1"      # client below server: dst_port stays 443
    two_exts = b"\x00\x0b\x00\x02\x01\x00" + b"\x00\x0a\x00\x04\x00\x02\x00\x17"
    fs = [
        frame(c, s, 5000, 443, payload=client_hello(b"www.youtube.com")),
        frame(c, s, 5000, 443, payload=client_hello(b"a.example", extra_ext=two_exts)),
        frame(c, s, 5000, 443, payload=client_hello(b"")),                  # empty SNI
        frame(c, s, 5000, 443, payload=client_hello(
            b"x", sni_ext=b"\x00\x00\x00\x04" + b"\x00\x02\x00\x00")),       # ext len 4
        frame(c, s, 5000, 443, payload=client_hello(
            b"x", sni_ext=b"\x00\x00\x00\x06\x00\x04\x01\x00\x01x")),       # name type 1
        frame(c, s, 5000, 443, proto=17, payload=client_hello(b"udp.example")),
        frame(c, s, 5000, 443, payload=client_hello(b"caf\xc3\xa9.example")),
        frame(s, "30.0.0.1", 443, 5000, payload=client_hello(b"lower.port")),  # 443 is src
        frame(c, s, 5000, 443, payload=client_hello(b"www.youtube.com")[:60]),  # cut
    ]
    rows = run(spark, fs)
    assert rows[0].sni == "www.youtube.com" and rows[0].named == "YouTube"
    assert rows[1].sni == "a.example"
    assert rows[2].sni == "" and rows[2].host == "" and rows[2].named is None
    assert rows[3].sni is None and rows[4].sni is None
    assert rows[5].sni == "udp.example"
    assert rows[6].sni == "caf��.example"
    assert rows[7].sni is None and rows[7].port_app == "UNKNOWN"
    assert rows[8].sni is None


def test_http_host_cases(spark):
    c, s = "10.0.0.1", "20.0.0.1"

    def req(text):
        return frame(c, s, 5000, 80, payload=text.encode("latin-1"))
    fs = [
        req("GET / HTTP/1.1\r\nHost: example.com\r\n\r\n"),
        req("GET /\r\nHost:x"),                                   # 15 bytes
        req("PATCH / HTTP/1.1\r\nHost: a.com\r\n\r\n"),
        req("get / HTTP/1.1\r\nHost: a.com\r\n\r\n"),
        req("GET / HTTP/1.1\r\nHOST: a.com\r\n\r\n"),
        req("GET / HTTP/1.1\r\nHost:a.com\r\n\r\n"),
        req("GET / HTTP/1.1\r\nhost: a\r\nHost: b\r\n\r\n"),
        req("GET / HTTP/1.1\r\nHost: tail.example"),
        req("GET / HTTP/1.1\r\nHost: \t a:8080 \r\n\r\n"),
        frame(c, s, 5000, 80, payload=b"GET / HTTP/1.1\r\nHost: x\xff.com\r\n\r\n"),
        req("OPTIONS * HTTP/1.1\r\nhost: opt.example\r\n"),
    ]
    rows = run(spark, fs)
    got = [r.http_host for r in rows]
    assert got == ["example.com", None, None, None, None, None, "b", "tail.example", "a:8080",
                   "x�.com", "opt.example"]
    assert rows[0].port_app == "HTTP" and rows[0].named is None


def test_classify_order(spark):
    c, s = "10.0.0.1", "20.0.0.1"

    def req(h):
        return frame(c, s, 5000, 8080, payload=f"GET / HTTP/1.1\r\nHost: {h}\r\n\r\n".encode())
    rows = run(spark, [req("youtube.googleapis.com"), req("x.com"), req("WWW.GitHub.COM"),
                       req("static.fbcdn.net"), req("media.tiktokcdn.com")])
    assert [r.named for r in rows] == ["YouTube", None, "GitHub", "Facebook", "TikTok"]


def test_service_port_mode(spark):
    rows = run(spark, [frame("200.0.0.1", "10.0.0.1", 443, 5000,
                             payload=client_hello(b"www.youtube.com"))], port_mode="service")
    assert rows[0].svc_port == 443 and rows[0].sni == "www.youtube.com"

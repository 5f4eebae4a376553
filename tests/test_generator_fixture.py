"""The reference generator's ten packets with hand-derived answers
(FIXTURES §2): every key is swapped, so no SNI is looked for and every flow
is UNKNOWN; only example.com is detected."""

import pytest
from frames import client_hello, frame, raw_df

from wirelens.operators.rules import load_rules
from wirelens.plans.analyze import analyze


def ten_packets():
    fs = [
        frame("192.168.1.10", "142.250.80.46", 54321, 443, payload=client_hello(b"www.youtube.com")),
        frame("192.168.1.11", "157.240.192.35", 54321, 443, payload=client_hello(b"www.facebook.com")),
        frame("192.168.1.12", "142.250.80.46", 54321, 443, payload=client_hello(b"www.google.com")),
        frame("192.168.1.13", "93.184.216.34", 54322, 80,
              payload=b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n"),
        frame("192.168.1.14", "8.8.8.8", 12345, 53, proto=17, payload=bytes(12)),
    ]
    fs += [frame(f"192.168.1.{20 + i}", f"10.0.0.{i}", 12345, 8080, payload=b"\x01\x02\x03")
           for i in range(5)]
    return fs


@pytest.fixture(scope="module")
def raw(spark):
    return raw_df(spark, ten_packets(), capture_id="generated")


def test_sizes_and_totals(spark, raw):
    a = analyze(raw)
    t = a.totals.collect()[0]
    assert (t.total_packets, t.total_bytes, t.tcp_packets, t.udp_packets) == (10, 820, 9, 1)
    assert (t.forwarded, t.dropped) == (10, 0)
    sizes = [r.packet_bytes for r in a.verdicts.orderBy("seq").collect()]
    assert sizes == [130, 131, 129, 91, 54, 57, 57, 57, 57, 57]


def test_breakdown_and_hosts(spark, raw):
    for mode in ("packet", "flow"):
        a = analyze(raw, mode=mode)
        apps = [tuple(r) for r in a.apps.select("app", "count", "percentage", "blocked", "bar").collect()]
        assert apps == [("UNKNOWN", 10, 100.0, False, "#" * 20)]
        assert [(r.host, r.app) for r in a.hosts.collect()] == [("example.com", "UNKNOWN")]
    assert a.flows.count() == 10


@pytest.mark.parametrize("kind,value,dropped", [
    ("domains", "example", 1), ("ips", "192.168.1.10", 0), ("ips", "8.8.8.8", 1),
    ("apps", "UNKNOWN", 10)])
def test_rules(spark, raw, kind, value, dropped):
    rules, rejects = load_rules(spark, **{kind: [value]})
    assert rejects.count() == 0
    t = analyze(raw, rules).totals.collect()[0]
    assert t.dropped == dropped and t.forwarded == 10 - dropped


def test_either_endpoint_option(spark, raw):
    rules, _ = load_rules(spark, ips=["192.168.1.10"])
    t = analyze(raw, rules, ip_match="either").totals.collect()[0]
    assert t.dropped == 1


def test_service_port_mode(spark, raw):
    v = analyze(raw, port_mode="service").verdicts.orderBy("seq").collect()
    assert [r.app_state for r in v] == ["YouTube", "Facebook", "Google", "HTTP", "DNS",
                                        "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]

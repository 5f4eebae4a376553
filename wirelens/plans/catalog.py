"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the packets Spark derives from the
whole ``events`` table of ``sf_dir``. Column names and types match the
oracle SQL in ``oracle.py`` (every integer is BIGINT).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.apps import APP_NAMES, app_label
from ..functions.ip import flow_label, ip_format, ip_parse
from ..operators import report as R
from ..operators.flows import flow_table, packets_with_flow
from ..operators.rules import load_rules, rule_flags, validate_rules
from ..operators.verdicts import packet_hosts, split_packets, verdicts
from ..schemas import APP_KEYWORDS
from ..sources.events import HOSTS, load_events, packets
from .analyze import analyze
from .oracle import (APP_RULES_MIXED, DOMAIN_RULES_MIXED, KEYWORD_TABLE, RULE_APPS,
                     RULE_DOMAINS, RULE_IPS)

c = F.col
_cache: dict = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, build):
    """Per-session cache of a DataFrame *definition* (not of data)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def _raw(spark, sf, layout="single"):
    return packets(spark, sf, layout)


def _hosts(spark, sf, layout="single"):
    return packet_hosts(_raw(spark, sf, layout))


def _parsed(df: DataFrame) -> DataFrame:
    return df.filter(c("is_parsed"))


def standard_rules(spark: SparkSession) -> DataFrame:
    return load_rules(spark, ips=RULE_IPS, apps=RULE_APPS, domains=RULE_DOMAINS)[0]


def _verdicts(spark, sf, layout="single"):
    return verdicts(_hosts(spark, sf, layout), standard_rules(spark))


def _analysis(spark, sf, layout="single", mode="packet"):
    return analyze(_raw(spark, sf, layout), standard_rules(spark), mode=mode,
                   processing_time_ms=0)


def _b(col: str) -> F.Column:
    return c(col).cast("bigint").alias(col)


# --- decode ----------------------------------------------------------------

def q_decode_gate(spark, sf):
    return _hosts(spark, sf).select(_b("seq"), "is_parsed", _b("packet_bytes"))


def q_decode_headers(spark, sf):
    from ..operators.decode import decode_packets
    d = decode_packets(_raw(spark, sf))
    return _parsed(d).select(_b("seq"), _b("protocol"), _b("ip_header_len"), _b("l4_header_len"),
                             _b("wire_src_ip"), _b("wire_dst_ip"), _b("wire_src_port"),
                             _b("wire_dst_port"))


def q_payload_stats(spark, sf):
    from ..operators.decode import decode_packets
    d = decode_packets(_raw(spark, sf))
    return _parsed(d).select(_b("seq"), _b("payload_offset"), _b("payload_len"),
                             (c("payload_len") > 0).alias("has_payload"))


def q_flow_key(spark, sf):
    return _parsed(_hosts(spark, sf)).select(_b("seq"), _b("src_ip"), _b("dst_ip"), _b("src_port"),
                                             _b("dst_port"), _b("protocol"))


def q_ip_format(spark, sf):
    return _parsed(_hosts(spark, sf)).select(_b("seq"), ip_format("src_ip").alias("src_ip_text"),
                                             ip_format("dst_ip").alias("dst_ip_text"))


def q_ip_parse(spark, sf):
    from ..operators.decode import decode_packets
    d = _parsed(decode_packets(_raw(spark, sf)))
    ip = c("wire_src_ip")
    text = F.concat(
        F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8)]),
        F.lit("."), (ip.bitwiseAND(255) + 256 * (c("seq") % 2)).cast("string"),
        F.when(c("seq") % 3 == 0, F.lit(".7")).otherwise(F.lit("")))
    return d.select(_b("seq"), text.alias("ip_text")).select(
        "seq", "ip_text", ip_parse("ip_text").alias("ip"))


def q_flow_label(spark, sf):
    return _parsed(_hosts(spark, sf)).select(
        _b("seq"), flow_label("src_ip", "src_port", "dst_ip", "dst_port", "protocol").alias("flow_label"))


def q_bypass_packets(spark, sf):
    from ..operators.decode import bypass_packets, decode_packets
    d = bypass_packets(decode_packets(_raw(spark, sf)))
    return d.select(_b("seq"), F.length("data").cast("bigint").alias("packet_bytes"),
                    F.hex(F.substring("data", 13, 2)).alias("ethertype"))


# --- inspect / classify ------------------------------------------------------

def q_sni_extract(spark, sf):
    return _hosts(spark, sf).filter(c("sni").isNotNull()).select(_b("seq"), "sni")


def q_http_host_extract(spark, sf):
    return _hosts(spark, sf).filter(c("http_host").isNotNull()).select(_b("seq"), "http_host")


def q_host_per_packet(spark, sf):
    return _hosts(spark, sf).filter(c("host").isNotNull()).select(_b("seq"), "host")


def q_classify_keyword(spark, sf):
    return _parsed(_hosts(spark, sf)).select(_b("seq"), "named")


def q_classify_port(spark, sf):
    return _parsed(_hosts(spark, sf)).select(_b("seq"), "port_app")


def q_classify_packet(spark, sf):
    return _parsed(_hosts(spark, sf)).select(
        _b("seq"), F.coalesce("named", "port_app").alias("app"))


def q_classify_keyword_table(spark, sf):
    kw = spark.createDataFrame(KEYWORD_TABLE, APP_KEYWORDS)
    h = packet_hosts(_raw(spark, sf), keywords=kw)
    return _parsed(h).select(_b("seq"), "named")


def q_app_label(spark, sf):
    v = _parsed(_verdicts(spark, sf))
    return v.select(_b("seq"), F.upper("app_state").alias("app_name")).select(
        "seq", "app_name", app_label("app_name").alias("label"))


# --- rules -------------------------------------------------------------------

def derived_rule_candidates(spark, sf) -> DataFrame:
    """A rule table derived from ``events`` (valid and invalid entries)."""
    ev = load_events(spark, sf)
    names = F.array(*[F.lit(n.lower()) for n in APP_NAMES])
    hosts = F.array(*[F.lit(h) for h in HOSTS])
    hidx = ((c("event_id") * 7 + c("user_id") * 3) % 12 + 1).cast("int")
    parts = [
        ev.select(F.lit("ip").alias("rule_type"),
                  F.concat(F.lit("192.168.1."), c("user_id").cast("string")).alias("value")),
        ev.filter(c("user_id") % 10 == 0).select(
            F.lit("ip"), F.concat_ws(".", c("user_id").cast("string"), c("user_id").cast("string"))),
        ev.select(F.lit("app"), c("event_type")),
        ev.select(F.lit("app"), F.element_at(names, (c("user_id") % 12 + 1).cast("int"))),
        ev.filter(c("event_type").isin("view", "click")).select(
            F.lit("domain"), F.element_at(hosts, hidx)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().withColumn("capture_id", F.lit(None).cast("string"))


def q_rules_validate(spark, sf):
    valid, rejects = validate_rules(derived_rule_candidates(spark, sf))
    v = valid.select("rule_type", "value", "ip", "app", "domain",
                     F.lit(None).cast("string").alias("error"))
    r = rejects.select("rule_type", "value", F.lit(None).cast("bigint").alias("ip"),
                       F.lit(None).cast("string").alias("app"),
                       F.lit(None).cast("string").alias("domain"), "error")
    return v.unionByName(r)


def _state(spark, sf):
    return _memo(spark, sf, "state", lambda: verdicts(_hosts(spark, sf), None))


def q_rule_ip(spark, sf):
    ev = load_events(spark, sf)
    # block list: the client address of every seventh user
    ips = (ev.filter(c("user_id") % 7 == 0)
           .select(F.lit("ip").alias("rule_type"),
                   ip_format(F.lit(3232235776) + c("user_id")).alias("value"),
                   F.lit(None).cast("string").alias("capture_id")).distinct())
    rules, _ = validate_rules(ips)
    st = _parsed(_state(spark, sf))
    low = rule_flags(st, rules, ip_match="low_endpoint").select(
        "seq", c("ip_hit").alias("ip_low"))
    either = rule_flags(st, rules, ip_match="either").select(
        "seq", c("ip_hit").alias("ip_either"))
    return low.join(either, "seq").select(_b("seq"), "ip_low", "ip_either")


def q_rule_app(spark, sf):
    rules, _ = load_rules(spark, apps=APP_RULES_MIXED)
    st = _parsed(_state(spark, sf))
    return rule_flags(st, rules).select(_b("seq"), "app_state", "app_hit")


def large_patterns(spark, sf) -> DataFrame:
    """``text``: a pattern for each event, cut from the hosts; six in seven
    carry the event's number, so that the table grows with the events and
    most of it matches nothing."""
    ev = load_events(spark, sf)
    host = F.lower(F.element_at(F.array(*[F.lit(h) for h in HOSTS]), ((c("event_id") * 7 + c("user_id") * 3) % 12 + 1).cast("int")))
    piece = F.substring(host, (c("event_id") % 5 + 1).cast("int"), (c("user_id") % 9 + 1).cast("int"))
    tail = F.when(c("event_id") % 7 == 0, F.lit("")).otherwise(c("event_id").cast("string"))
    return ev.select("event_id", F.concat(piece, tail).alias("text"))


def q_rule_domain_large(spark, sf):
    """Domain rules as many as events (those of one character kept to the
    capture of their day, which is not this one)."""
    t = large_patterns(spark, sf).filter(F.length("text") > 0)
    rules, _ = validate_rules(t.select(F.lit("domain").alias("rule_type"), F.upper("text").alias("value"),
                                       F.when(F.length("text") < 4, F.lit("other")).alias("capture_id")))
    st = _parsed(_state(spark, sf))
    return rule_flags(st, rules).select(_b("seq"), "host_state", "dom_hit")


def q_classify_keyword_large(spark, sf):
    t = large_patterns(spark, sf)
    kw = t.filter(F.length("text") > 2).select((c("event_id") % 1000).cast("int").alias("priority"), c("text").alias("keyword"),
                  F.concat(F.lit("class "), (c("event_id") % 50).cast("string")).alias("app"))
    return _parsed(packet_hosts(_raw(spark, sf), keywords=kw)).select(_b("seq"), "named")


def q_rules_many_captures(spark, sf):
    """Rules of single captures (days): by address, class and domain."""
    ev = load_events(spark, sf)
    day = F.date_format("ts", "yyyy-MM-dd")
    some = lambda n: c("event_id") % n == 0
    rules, _ = validate_rules(
        ev.filter(some(40)).select(F.lit("ip").alias("rule_type"), ip_format(F.lit(3232235776) + c("user_id")).alias("value"), day.alias("capture_id"))
        .union(ev.filter(some(900)).select(F.lit("app"), F.lit("github"), day))
        .union(ev.filter(some(700)).select(F.lit("domain"), F.concat(F.lit("goo"), F.substring(F.lit("gle"), 1, (c("event_id") % 3 + 1).cast("int"))), day))
        .distinct())
    v = verdicts(_hosts(spark, sf, "daily"), rules)
    return v.select("capture_id", _b("seq"), "blocked", "block_reason")


def q_rule_domain(spark, sf):
    rules, _ = load_rules(spark, domains=DOMAIN_RULES_MIXED)
    st = _parsed(_state(spark, sf))
    return rule_flags(st, rules).select(_b("seq"), "host_state", "dom_hit")


# --- flow state and verdicts -------------------------------------------------

def q_app_state(spark, sf):
    return _parsed(_state(spark, sf)).select(_b("seq"), "app_state")


def q_host_state(spark, sf):
    return _parsed(_state(spark, sf)).select(_b("seq"), "host_state")


def q_flow_running(spark, sf):
    return _parsed(_state(spark, sf)).select(_b("seq"), _b("flow_packets"), _b("flow_bytes"))


def q_verdicts(spark, sf):
    return _verdicts(spark, sf).select(_b("seq"), "is_parsed", "app_state", "host_state",
                                       "blocked", "block_reason")


def q_verdict_totals(spark, sf):
    v = _verdicts(spark, sf)
    return v.groupBy("capture_id").agg(
        F.count_if(~c("blocked")).alias("forwarded"), F.count_if(c("blocked")).alias("dropped"),
        F.count_if(c("block_reason") == "ip").alias("dropped_ip"),
        F.count_if(c("block_reason") == "app").alias("dropped_app"),
        F.count_if(c("block_reason") == "domain").alias("dropped_domain"))


def q_packets_with_flow(spark, sf):
    h = _hosts(spark, sf)
    return packets_with_flow(h, flow_table(h)).select(
        _b("seq"), c("flow_packet_count").cast("bigint").alias("flow_packet_count"),
        c("flow_byte_count").cast("bigint").alias("flow_byte_count"),
        c("flow_app").alias("flow_app"), c("flow_host").alias("flow_host"))


def q_forwarded_packets(spark, sf):
    return split_packets(_raw(spark, sf), _verdicts(spark, sf))[0].select(_b("seq"), _b("incl_len"))


def q_dropped_packets(spark, sf):
    return split_packets(_raw(spark, sf), _verdicts(spark, sf))[1].select(_b("seq"), _b("incl_len"))


# --- flows and reports ---------------------------------------------------------

def q_flow_table(spark, sf):
    f = _analysis(spark, sf).flows
    return f.select("capture_id", _b("src_ip"), _b("dst_ip"), _b("src_port"), _b("dst_port"),
                    _b("protocol"), _b("packet_count"), _b("byte_count"), "app", "host", "blocked")


def q_traffic_totals(spark, sf):
    return _analysis(spark, sf).totals


def q_app_breakdown_packet(spark, sf):
    return _analysis(spark, sf, mode="packet").apps


def q_app_breakdown_flow(spark, sf):
    return _analysis(spark, sf, mode="flow").apps


def q_detected_hosts_packet(spark, sf):
    return _analysis(spark, sf, mode="packet").hosts.select("capture_id", "host", "app", _b("first_seq"))


def q_detected_hosts_flow(spark, sf):
    return _analysis(spark, sf, mode="flow").hosts.select("capture_id", "host", "app", _b("first_seq"))


def _apps_text(rep: DataFrame) -> DataFrame:
    item = lambda s: F.concat_ws(":", s["appType"], s["count"].cast("string"),
                                 s["percentage"].cast("string"), s["blocked"].cast("string"))
    return rep.select(
        "capture_id", "total_packets", "total_bytes", "tcp_packets", "udp_packets", "forwarded",
        "dropped", "processing_time_ms",
        F.array_join(F.transform("app_breakdown", item), ";").alias("apps"), "detected_hosts")


def q_traffic_report(spark, sf):
    return _apps_text(_analysis(spark, sf).report)


def q_report_one_pass(spark, sf):
    return R.report_sections(_analysis(spark, sf, layout="daily").segments)


def q_report_per_capture(spark, sf):
    return _apps_text(_analysis(spark, sf, layout="daily").report)


def q_report_csv_lines(spark, sf):
    a = _analysis(spark, sf)
    return R.report_csv_lines(a.totals, a.apps, a.hosts).select(
        "capture_id", c("section").cast("int").alias("section"), _b("ord"), _b("k"), "line")


def q_report_json(spark, sf):
    a = _analysis(spark, sf)
    return R.report_json_lines(a.totals, a.apps, a.hosts).select(
        "capture_id", c("section").cast("int").alias("section"), _b("ord"), _b("k"), "line")


def _register_sources():
    from . import io_queries
    return io_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    io = _register_sources()
    return {
        "traffic_totals": q_traffic_totals,
        "decode_gate": q_decode_gate,
        "decode_headers": q_decode_headers,
        "payload_stats": q_payload_stats,
        "flow_key": q_flow_key,
        "ip_format": q_ip_format,
        "ip_parse": q_ip_parse,
        "flow_label": q_flow_label,
        "bypass_packets": q_bypass_packets,
        "sni_extract": q_sni_extract,
        "http_host_extract": q_http_host_extract,
        "host_per_packet": q_host_per_packet,
        "classify_keyword": q_classify_keyword,
        "classify_port": q_classify_port,
        "classify_packet": q_classify_packet,
        "classify_keyword_table": q_classify_keyword_table,
        "app_label": q_app_label,
        "rules_validate": q_rules_validate,
        "rule_ip": q_rule_ip,
        "rule_app": q_rule_app,
        "rule_domain": q_rule_domain,
        "rule_domain_large": q_rule_domain_large,
        "classify_keyword_large": q_classify_keyword_large,
        "rules_many_captures": q_rules_many_captures,
        "app_state": q_app_state,
        "host_state": q_host_state,
        "flow_running": q_flow_running,
        "verdicts": q_verdicts,
        "verdict_totals": q_verdict_totals,
        "packets_with_flow": q_packets_with_flow,
        "forwarded_packets": q_forwarded_packets,
        "dropped_packets": q_dropped_packets,
        "flow_table": q_flow_table,
        "app_breakdown_packet": q_app_breakdown_packet,
        "app_breakdown_flow": q_app_breakdown_flow,
        "detected_hosts_packet": q_detected_hosts_packet,
        "detected_hosts_flow": q_detected_hosts_flow,
        "report_one_pass": q_report_one_pass,
        "report_per_capture": q_report_per_capture,
        "report_csv_lines": q_report_csv_lines,
        "traffic_report": q_traffic_report,
        "report_json": q_report_json,
        **io.queries(),
    }


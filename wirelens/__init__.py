"""wirelens: captured network traffic analysis on Spark.

Packets are rows (``raw_packets``); decoding, host extraction,
classification, per-flow state, block rules and reports are DataFrame
operations. See README.md for the operator map.
"""

from .functions.apps import app_label, classify, named_app, port_app
from .functions.ip import flow_label, ip_format, ip_parse
from .functions.report import bar, share_pct
from .operators.classify import classify_hosts, default_keywords
from .operators.decode import bypass_packets, decode_packets, to_raw, with_flow_key
from .operators.flows import flow_table, packets_with_flow, with_flow_state
from .operators.inspect import inspect_hosts, with_http_host, with_sni
from .operators.report import (app_breakdown, detected_hosts, report_csv_lines,
                               report_json_lines, segments, traffic_report, traffic_totals,
                               write_report_csv, write_report_json)
from .operators.rules import apply_rules, load_rules, validate_rules
from .operators.verdicts import dropped_packets, forwarded_packets, packet_hosts, verdicts
from .plans.analyze import Analysis, analyze
from .sources.inventory import capture_inventory
from .sources.ranges import read_pcap_errors
from .sources.pcap import read_pcap, register, write_pcap

__all__ = [
    "app_label", "classify", "named_app", "port_app", "flow_label", "ip_format", "ip_parse",
    "bar", "share_pct", "classify_hosts", "default_keywords", "bypass_packets",
    "decode_packets", "to_raw", "with_flow_key", "flow_table", "packets_with_flow",
    "with_flow_state", "inspect_hosts", "with_http_host", "with_sni", "app_breakdown",
    "detected_hosts", "report_csv_lines", "report_json_lines", "segments", "traffic_report",
    "traffic_totals", "write_report_csv", "write_report_json", "apply_rules", "load_rules",
    "validate_rules", "dropped_packets", "forwarded_packets", "packet_hosts", "verdicts",
    "Analysis", "analyze", "capture_inventory", "read_pcap_errors",
    "read_pcap", "register", "write_pcap",
]

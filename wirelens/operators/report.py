"""Traffic reports.

All report outputs derive from one small aggregate, ``segments``: packets
grouped by (capture, flow key, app_state, host_state). It is a hash
aggregate with map-side partials, so a hot flow or the unparsed bucket
shrinks before the shuffle, and it has roughly one row per flow. Totals,
both breakdown modes, both host lists and the flow table then read that
table, never the packets again.

Report tables are per ``capture_id`` (E2). Percentages divide by the
capture's total packet count, which includes unparsed packets; the total
comes from a window over the capture's few breakdown rows (no join).
Detected-host lists are never collected into a single row: they stay
tables, and the JSON / CSV renderings are line tables with sort keys that a
writer orders (``write_report_*``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.report import bar, raw_pct, round_half_up_1
from ..schemas import FLOW_KEY
from .rules import apply_rules, blocked_apps_flag

PARSED_KEY = FLOW_KEY[1:]


def segments(v: DataFrame) -> DataFrame:
    """Packets grouped by (capture, is_parsed, flow key, protocol, state).
    ``n_blocked`` only where ``v`` has verdicts; else ``judged`` adds it."""
    c = F.col
    blocked = [F.count_if(c("blocked")).alias("n_blocked")] if "blocked" in v.columns else []
    return v.groupBy("capture_id", "is_parsed", *PARSED_KEY, "app_state", "host_state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("packet_bytes").cast("bigint").alias("bytes"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        *blocked,
    )


def judged(seg: DataFrame, rules: DataFrame | None, ip_match: str = "low_endpoint") -> DataFrame:
    """Segments with ``block_reason`` and ``n_blocked`` (W3). A verdict depends
    on the flow's addresses and its state only, which a segment's packets
    share, so rules are matched on about one row per flow, not on packets."""
    j = apply_rules(seg, rules, ip_match=ip_match)
    hit = F.coalesce(F.col("blocked") & F.col("is_parsed"), F.lit(False))
    return j.withColumns({"n_blocked": F.when(hit, F.col("n")).otherwise(F.lit(0)).cast("bigint"),
                          "block_reason": F.when(hit, F.col("block_reason"))}).drop("blocked")


def packet_verdicts(st: DataFrame, seg: DataFrame) -> DataFrame:
    """Packets with state and the verdict of their segment (``judged``):
    ``blocked``, ``block_reason``. Joined on flow and state; unparsed packets,
    never blocked, are spread over the join."""
    state = F.struct(*FLOW_KEY, "app_state", "host_state")
    # 0 of every hit, but no literal: that would be folded into a condition beside the join key
    none = F.least(F.col("n_blocked"), F.lit(0)).cast("bigint")
    hit = seg.filter(F.col("n_blocked") > 0).select(state.alias("__state"), none.alias("__at"), "block_reason")
    spread = F.when(F.col("is_parsed"), F.lit(0)).otherwise(F.xxhash64("capture_id", "seq"))
    out = st.withColumns({"__state": state, "__at": spread}).join(hit, ["__state", "__at"], "left")
    return out.withColumn("blocked", F.col("block_reason").isNotNull()).drop("__state", "__at")


def traffic_totals(seg: DataFrame) -> DataFrame:
    """Totals per capture (A1-A3): all packets incl. unparsed; TCP/UDP count
    parsed packets only; forwarded includes unparsed packets."""
    c = F.col
    parsed = c("is_parsed")
    return seg.groupBy("capture_id").agg(
        F.sum("n").cast("bigint").alias("total_packets"),
        F.sum("bytes").cast("bigint").alias("total_bytes"),
        F.coalesce(F.sum(F.when(parsed & (c("protocol") == 6), c("n"))), F.lit(0))
        .cast("bigint").alias("tcp_packets"),
        F.coalesce(F.sum(F.when(parsed & (c("protocol") == 17), c("n"))), F.lit(0))
        .cast("bigint").alias("udp_packets"),
        F.sum(c("n") - c("n_blocked")).cast("bigint").alias("forwarded"),
        F.sum("n_blocked").cast("bigint").alias("dropped"),
    )


def flows_from_segments(seg: DataFrame) -> DataFrame:
    """The flow table (A4) from segments: the final state is the state of
    the segment holding the flow's last packet; ``first_seq`` is the flow's
    first packet."""
    c = F.col
    return (seg.filter(c("is_parsed")).groupBy(*FLOW_KEY).agg(
        F.sum("n").cast("bigint").alias("packet_count"),
        F.sum("bytes").cast("bigint").alias("byte_count"),
        F.max_by("app_state", "last_seq").alias("app"),
        F.max_by("host_state", "last_seq").alias("host"),
        F.bool_or(c("n_blocked") > 0).alias("blocked"),
        F.min("first_seq").alias("first_seq"),
    ))


def _breakdown(counts: DataFrame, rules: DataFrame | None) -> DataFrame:
    """counts(capture_id, app, count) incl. one NULL-app row per capture for
    packets outside the breakdown -> percentage, bar, blocked (X9, X10, J6)."""
    w = Window.partitionBy("capture_id")
    t = counts.withColumn("__total", F.sum("count").over(w)).filter(F.col("app").isNotNull())
    pct = raw_pct(F.col("count"), F.col("__total"))
    out = t.select("capture_id", "app", F.col("count").cast("bigint").alias("count"),
                   round_half_up_1(pct).alias("percentage"), bar(pct).alias("bar"))
    out = blocked_apps_flag(out, rules, app_col="app")
    return out.select("capture_id", "app", "count", "percentage", "blocked", "bar")


def app_breakdown(seg: DataFrame, rules: DataFrame | None = None, mode: str = "packet") -> DataFrame:
    """Per-application packet counts (A5 packet mode, A6 flow mode).

    Packet mode counts each packet under its flow's class *at that packet*;
    flow mode counts a flow's packets under its *final* class. Order with
    ``ORDER BY count DESC, app`` (O1; the reference leaves ties undefined).
    """
    c = F.col
    if mode == "packet":
        counts = seg.groupBy("capture_id", F.col("app_state").alias("app")).agg(
            F.sum("n").alias("count"))
    elif mode == "flow":
        flows = flows_from_segments(seg)
        by_app = flows.groupBy("capture_id", "app").agg(F.sum("packet_count").alias("count"))
        unparsed = (seg.filter(~c("is_parsed")).groupBy("capture_id")
                    .agg(F.sum("n").alias("count"))
                    .select("capture_id", F.lit(None).cast("string").alias("app"), "count"))
        counts = by_app.unionByName(unparsed)
    else:
        raise ValueError(f"mode must be 'packet' or 'flow', not {mode!r}")
    return _breakdown(counts, rules)


def detected_hosts(seg: DataFrame, mode: str = "packet") -> DataFrame:
    """Distinct (host, app) pairs with a non-empty host.

    Packet mode: the flow's (host_state, app_state) at every packet, with
    ``first_seq`` = first packet showing the pair (order by it: O2).
    Flow mode: each flow's final (host, app); ``first_seq`` = the first
    packet of the earliest such flow.
    """
    c = F.col
    if mode == "packet":
        return (seg.filter(c("is_parsed") & (F.length("host_state") > 0))
                .groupBy("capture_id", c("host_state").alias("host"), c("app_state").alias("app"))
                .agg(F.min("first_seq").alias("first_seq")))
    if mode == "flow":
        fl = flows_from_segments(seg)
        return (fl.filter(F.length("host") > 0).groupBy("capture_id", "host", "app")
                .agg(F.min("first_seq").alias("first_seq")))
    raise ValueError(f"mode must be 'packet' or 'flow', not {mode!r}")


def report_sections(seg: DataFrame) -> DataFrame:
    """Totals (A1-A3), application counts (A5) and detected hosts (A7) of
    every capture by one aggregate over grouping sets: one pass over the
    segments and one exchange, where the separate aggregates take three.

    ``section`` tells the rows apart: ``total`` (a row a capture), ``app``
    (``app`` set; unparsed packets are in the totals only) and ``host``
    (``app`` and ``host`` set, non-empty hosts only). Columns: ``packets``,
    ``bytes``, ``tcp_packets``, ``udp_packets``, ``forwarded``, ``dropped``,
    ``first_seq``. Packet mode.
    """
    c = F.col
    parsed = c("is_parsed")

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")

    cols = ["capture_id", "app_state", "host_state"]
    sets = seg.groupingSets([cols[:1], cols[:2], cols], *cols).agg(
        F.grouping_id(*cols).alias("__set"),
        total(c("n")).alias("packets"), total(c("bytes")).alias("bytes"),
        total(F.when(parsed & (c("protocol") == 6), c("n"))).alias("tcp_packets"),
        total(F.when(parsed & (c("protocol") == 17), c("n"))).alias("udp_packets"),
        total(c("n") - c("n_blocked")).alias("forwarded"), total(c("n_blocked")).alias("dropped"),
        F.min("first_seq").alias("first_seq"))
    section = F.when(c("__set") == 3, "total").when(c("__set") == 1, "app").otherwise("host")
    out = sets.select(section.alias("section"), "capture_id", c("app_state").alias("app"), c("host_state").alias("host"),
                      *[x for x in sets.columns if x not in (*cols, "__set")])
    return out.filter((c("section") == "total") | ((c("section") == "app") & c("app").isNotNull())
                      | ((c("section") == "host") & c("app").isNotNull() & (F.length("host") > 0)))


def traffic_report(totals: DataFrame, apps: DataFrame, hosts: DataFrame,
                   processing_time_ms: int | Column = 0) -> DataFrame:
    """One row per capture (A9): totals, the breakdown as an array of
    structs (at most twelve classes, ordered by count desc, app), and the
    number of detected hosts. The host list itself stays the ``hosts``
    table, because it grows with the data."""
    ptm = processing_time_ms if isinstance(processing_time_ms, Column) else F.lit(processing_time_ms)
    app_arr = (apps.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("count")).alias("__k"), F.col("app").alias("appType"), "count",
        "percentage", "blocked", "bar"))).alias("__a"))
        .select("capture_id", F.transform("__a", lambda s: s.dropFields("__k")).alias("app_breakdown")))
    n_hosts = hosts.groupBy("capture_id").agg(F.count(F.lit(1)).alias("detected_hosts"))
    out = (totals.join(app_arr, "capture_id", "left").join(n_hosts, "capture_id", "left"))
    return out.select(
        "capture_id", "total_packets", "total_bytes", "tcp_packets", "udp_packets",
        "forwarded", "dropped", ptm.cast("bigint").alias("processing_time_ms"),
        F.coalesce("app_breakdown", F.array()).alias("app_breakdown"),
        F.coalesce("detected_hosts", F.lit(0)).cast("bigint").alias("detected_hosts"))


# --- report renderings (S4 JSON, S5 CSV) -----------------------------------
# Each rendering is a table (capture_id, section, ord, k, line); writing it
# ordered by (section, ord, k) gives the report file of a capture. ``ord`` is
# the rank or ``first_seq`` itself, whatever its size, and closing lines have
# sections of their own; no step collects the host list.

def _jstr(col) -> Column:
    """JSON string literal of a column (escaped as Jackson would)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), '^\\{"v":(.*)\\}$', 1)


def _lines(df: DataFrame, section: int, items: list[tuple[int, Column]], ord_col: Column) -> DataFrame:
    """One output row per (input row, item)."""
    arr = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), line.alias("line"))
                    for k, line in items])
    return (df.select("capture_id", ord_col.cast("bigint").alias("__o"), F.explode(arr).alias("__l"))
            .select("capture_id", F.lit(section).alias("section"),
                    F.col("__o").alias("ord"), F.col("__l.k").alias("k"), F.col("__l.line").alias("line")))


def _ranked_apps(apps: DataFrame) -> DataFrame:
    # at most twelve rows per capture: the window is over a bounded group
    w = Window.partitionBy("capture_id").orderBy(F.desc("count"), "app")
    return apps.withColumn("__rank", F.row_number().over(w))


def _host_firsts(hosts: DataFrame) -> DataFrame:
    first = hosts.groupBy("capture_id").agg(F.min("first_seq").alias("__min_seq"))
    return hosts.join(first, "capture_id").withColumn(
        "__first", F.col("first_seq") == F.col("__min_seq"))


def _totals_kv(totals: DataFrame, ptm: Column):
    return [("totalPackets", "Total Packets", F.col("total_packets")),
            ("totalBytes", "Total Bytes", F.col("total_bytes")),
            ("tcpPackets", "TCP Packets", F.col("tcp_packets")),
            ("udpPackets", "UDP Packets", F.col("udp_packets")),
            ("forwarded", "Forwarded", F.col("forwarded")),
            ("dropped", "Dropped", F.col("dropped")),
            ("processingTimeMs", "Processing Time (ms)", ptm)]


def report_json_lines(totals: DataFrame, apps: DataFrame, hosts: DataFrame,
                      processing_time_ms: int | Column = 0) -> DataFrame:
    """The JSON report (S4) as ordered lines, in the pretty-printed layout
    of the reference (two-space indent, ``" : "``, ``[ {`` / ``}, {``)."""
    ptm = processing_time_ms if isinstance(processing_time_ms, Column) else F.lit(processing_time_ms)
    kv = _totals_kv(totals, ptm)
    head = [(0, F.lit("{"))] + [
        (i + 1, F.concat(F.lit(f'  "{k}" : '), v.cast("bigint").cast("string"), F.lit(",")))
        for i, (k, _label, v) in enumerate(kv)]
    out = _lines(totals, 0, head, F.lit(0))
    ra = _ranked_apps(apps)
    first = F.col("__rank") == 1
    app_items = [
        (0, F.when(first, F.lit('  "appBreakdown" : [ {')).otherwise(F.lit("  }, {"))),
        (1, F.concat(F.lit('    "appType" : '), _jstr("app"), F.lit(","))),
        (2, F.concat(F.lit('    "count" : '), F.col("count").cast("string"), F.lit(","))),
        (3, F.concat(F.lit('    "percentage" : '), F.col("percentage").cast("string"), F.lit(","))),
        (4, F.concat(F.lit('    "blocked" : '), F.col("blocked").cast("string"), F.lit(","))),
        (5, F.concat(F.lit('    "bar" : '), _jstr("bar"))),
    ]
    out = out.unionByName(_lines(ra, 1, app_items, F.col("__rank")))
    hf = _host_firsts(hosts)
    host_items = [
        (0, F.when(F.col("__first"), F.lit('  "detectedSnis" : [ {')).otherwise(F.lit("  }, {"))),
        (1, F.concat(F.lit('    "sni" : '), _jstr("host"), F.lit(","))),
        (2, F.concat(F.lit('    "appType" : '), _jstr("app"))),
    ]
    out = out.unionByName(_lines(hf, 3, host_items, F.col("first_seq")))
    n_apps = apps.groupBy("capture_id").agg(F.count(F.lit(1)).alias("__na"))
    n_hosts = hosts.groupBy("capture_id").agg(F.count(F.lit(1)).alias("__nh"))
    tail = (totals.select("capture_id").join(n_apps, "capture_id", "left")
            .join(n_hosts, "capture_id", "left"))
    close_items = [
        (0, F.when(F.coalesce("__na", F.lit(0)) > 0, F.lit("  } ],"))
         .otherwise(F.lit('  "appBreakdown" : [ ],'))),
    ]
    out = out.unionByName(_lines(tail, 2, close_items, F.lit(0)))
    close_hosts = [
        (0, F.when(F.coalesce("__nh", F.lit(0)) > 0, F.lit("  } ]"))
         .otherwise(F.lit('  "detectedSnis" : [ ]'))),
    ]
    out = out.unionByName(_lines(tail, 4, close_hosts, F.lit(0)))
    out = out.unionByName(_lines(totals, 5, [(0, F.lit("}"))], F.lit(0)))
    return out


def report_csv_lines(totals: DataFrame, apps: DataFrame, hosts: DataFrame,
                     processing_time_ms: int | Column = 0) -> DataFrame:
    """The CSV report (S5) as ordered lines: metrics, a blank line, the
    breakdown, a blank line, the hosts. No quoting or escaping, and no bar
    column, as in the reference."""
    ptm = processing_time_ms if isinstance(processing_time_ms, Column) else F.lit(processing_time_ms)
    kv = _totals_kv(totals, ptm)
    head = [(0, F.lit("Metric,Value"))] + [
        (i + 1, F.concat(F.lit(f"{label},"), v.cast("bigint").cast("string")))
        for i, (_k, label, v) in enumerate(kv)]
    out = _lines(totals, 0, head, F.lit(0))
    out = out.unionByName(_lines(totals, 1, [(0, F.lit("")),
                                             (1, F.lit("Application,Count,Percentage,Blocked"))],
                                 F.lit(0)))
    ra = _ranked_apps(apps)
    line = F.concat_ws(",", F.col("app"), F.col("count").cast("string"),
                       F.col("percentage").cast("string"), F.col("blocked").cast("string"))
    out = out.unionByName(_lines(ra, 1, [(0, line)], F.col("__rank")))
    out = out.unionByName(_lines(totals, 2, [(0, F.lit("")), (1, F.lit("SNI,Application"))],
                                 F.lit(0)))
    hl = F.concat(F.col("host"), F.lit(","), F.col("app"))
    out = out.unionByName(_lines(hosts, 3, [(0, hl)], F.col("first_seq")))
    return out


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Write each capture's lines, in order, as text files under ``path``
    (``capture_id=<id>/part-*.txt``): range-partitioned on the sort key, so
    even a huge host list is written by many tasks in order."""
    (lines.repartitionByRange("capture_id", "section", "ord", "k")
     .sortWithinPartitions("capture_id", "section", "ord", "k")
     .select("capture_id", "line")
     .write.mode("overwrite").partitionBy("capture_id").text(path))


write_report_json = write_report_lines
write_report_csv = write_report_lines

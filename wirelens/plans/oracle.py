"""DuckDB oracle SQL for the registered queries.

The expected values are computed from the *logical* columns of the packets
derived from ``events`` (the CTE chain below follows FIXTURES.md §3), never
from frame bytes, so the Spark decoder is checked against something that
never parsed a byte. Every computed column is aliased to the Spark name and
cast to the Spark type (BIGINT for every integer).
"""

from __future__ import annotations

# --- fixed values shared with the Spark side (queries in catalog.py) -------
RULE_IPS = ["192.168.1.10"]
RULE_APPS = ["YOUTUBE"]
RULE_DOMAINS = ["facebook", "example"]
RULE_IP_VALUES = [3232235786]          # 192.168.1.10
KEYWORD_TABLE = [                      # (priority, keyword, app) for J4
    (0, "tube", "Video"), (0, "video", "Video"), (1, "google", "Search"),
    (2, "git", "Code"), (3, ".com", "Dotcom"), (9, "www", "Web"),
]
APP_RULES_MIXED = ["youtube", "DNS", "GitHub"]
DOMAIN_RULES_MIXED = ["facebook", "EXAMPLE", "tik", "googlevideo"]
# ---------------------------------------------------------------------------

_CAPTURE = {
    "single": "'events'",
    "daily": "strftime(ts, '%Y-%m-%d')",
}

_HOSTS_CASE = """CASE (event_id * 7 + user_id * 3) % 12
        WHEN 0 THEN 'www.youtube.com' WHEN 1 THEN 'i.ytimg.com' WHEN 2 THEN 'static.xx.fbcdn.net'
        WHEN 3 THEN 'www.google.com' WHEN 4 THEN 'pbs.twimg.com' WHEN 5 THEN 'www.netflix.com'
        WHEN 6 THEN 'v16.tiktokcdn.com' WHEN 7 THEN 'github.com' WHEN 8 THEN 's3.amazonaws.com'
        WHEN 9 THEN 'www.example.com' WHEN 10 THEN '' ELSE 'WWW.GoogleVideo.com' END"""

_NAMED_CASE = """CASE
    WHEN host IS NULL OR host = '' THEN NULL
    WHEN contains(lower(host), 'youtube') OR contains(lower(host), 'ytimg') OR contains(lower(host), 'googlevideo') THEN 'YouTube'
    WHEN contains(lower(host), 'facebook') OR contains(lower(host), 'fbcdn') OR contains(lower(host), 'instagram') THEN 'Facebook'
    WHEN contains(lower(host), 'google') OR contains(lower(host), 'gstatic') THEN 'Google'
    WHEN contains(lower(host), 'twitter') OR contains(lower(host), 'twimg') THEN 'Twitter'
    WHEN contains(lower(host), 'netflix') OR contains(lower(host), 'nflxvideo') THEN 'Netflix'
    WHEN contains(lower(host), 'tiktok') THEN 'TikTok'
    WHEN contains(lower(host), 'github') THEN 'GitHub'
    WHEN contains(lower(host), 'amazon') THEN 'Amazon' END"""


def base(layout: str = "single") -> str:
    """CTEs: b (logical packet), w (wire + normalised key), pb (lengths),
    h (host), n (classes), v (state), vb (verdict, standard rules),
    allv (every packet with its verdict)."""
    cap = _CAPTURE[layout]
    return f"""WITH b AS (
  SELECT event_id AS seq, ts, user_id, event_type, event_id % 4 AS slot, {cap} AS capture_id,
    epoch_us(ts) // 1000000 AS ts_sec, epoch_us(ts) % 1000000 AS ts_usec,
    CASE WHEN event_id % 97 = 0 THEN 'arp' WHEN event_id % 89 = 0 THEN 'icmp'
         WHEN event_id % 83 = 0 THEN 'trunc' ELSE 'ok' END AS kind,
    3232235776 + user_id AS client_ip,
    CASE WHEN user_id % 2 = 0 THEN 3405803776 ELSE 2398769152 END + event_id % 4 AS server_ip,
    40000 + event_id % 4 AS client_port,
    CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 ELSE 8080 END AS server_port,
    CASE event_id % 4 WHEN 2 THEN 17 ELSE 6 END AS protocol,
    CASE WHEN event_type IN ('view','click') THEN {_HOSTS_CASE} END AS host_sent
  FROM events),
w AS (SELECT *,
    CASE WHEN event_type = 'error' THEN server_ip ELSE client_ip END AS wire_src_ip,
    CASE WHEN event_type = 'error' THEN client_ip ELSE server_ip END AS wire_dst_ip,
    CASE WHEN event_type = 'error' THEN server_port ELSE client_port END AS wire_src_port,
    CASE WHEN event_type = 'error' THEN client_port ELSE server_port END AS wire_dst_port,
    CASE WHEN client_ip < server_ip THEN client_ip ELSE server_ip END AS src_ip,
    CASE WHEN client_ip < server_ip THEN server_ip ELSE client_ip END AS dst_ip,
    CASE WHEN client_ip < server_ip THEN client_port ELSE server_port END AS src_port,
    CASE WHEN client_ip < server_ip THEN server_port ELSE client_port END AS dst_port
  FROM b),
pk AS (SELECT *, kind = 'ok' AS is_parsed,
    CASE WHEN protocol = 6 THEN 20 ELSE 8 END AS l4_header_len,
    CASE WHEN host_sent IS NOT NULL AND slot = 0
              THEN 61 + (CASE WHEN user_id % 3 = 0 THEN 6 ELSE 0 END) + strlen(host_sent)
         WHEN host_sent IS NOT NULL THEN 26 + strlen(host_sent)
         WHEN event_type = 'purchase' THEN 26
         WHEN event_type = 'signup' THEN 3 ELSE 0 END AS payload_len
  FROM w),
pb AS (SELECT *, CASE WHEN kind = 'trunc' THEN 30 ELSE 34 + l4_header_len + payload_len END
    AS packet_bytes FROM pk),
h AS (SELECT *, CASE WHEN slot = 0 AND dst_port <> 443 THEN NULL ELSE host_sent END AS host,
    CASE WHEN host_sent IS NOT NULL AND slot = 0 AND dst_port = 443 THEN host_sent END AS sni,
    CASE WHEN host_sent IS NOT NULL AND slot <> 0 THEN host_sent END AS http_host
  FROM pb WHERE kind = 'ok'),
n AS (SELECT *, {_NAMED_CASE} AS named,
    CASE dst_port WHEN 443 THEN 'HTTPS' WHEN 80 THEN 'HTTP' WHEN 53 THEN 'DNS' ELSE 'UNKNOWN' END
    AS port_app FROM h),
v AS (SELECT *, CASE WHEN port_app = 'DNS' THEN coalesce(FN, 'DNS') ELSE coalesce(FNN, port_app) END
    AS app_state, LH AS host_state FROM (SELECT *,
    first_value(named) OVER x AS FN, first_value(named IGNORE NULLS) OVER x AS FNN,
    last_value(host IGNORE NULLS) OVER x AS LH,
    count(*) OVER x AS flow_packets, sum(packet_bytes) OVER x AS flow_bytes FROM n
    WINDOW x AS (PARTITION BY capture_id, src_ip, dst_ip, src_port, dst_port, protocol ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q),
vr AS (SELECT *, src_ip IN ({", ".join(str(i) for i in RULE_IP_VALUES)}) AS ip_hit,
    app_state IN ('YouTube') AS app_hit,
    coalesce(host_state <> '' AND ({" OR ".join(f"contains(lower(host_state), '{d}')" for d in RULE_DOMAINS)}), false)
    AS dom_hit FROM v),
vb AS (SELECT *, ip_hit OR app_hit OR dom_hit AS blocked,
    CASE WHEN ip_hit THEN 'ip' WHEN app_hit THEN 'app' WHEN dom_hit THEN 'domain' END AS block_reason
  FROM vr),
allv AS (SELECT pb.seq, pb.capture_id, pb.ts_sec, pb.ts_usec, pb.packet_bytes, pb.is_parsed,
    pb.protocol, pb.kind, vb.app_state, vb.host_state, coalesce(vb.blocked, false) AS blocked,
    vb.block_reason
  FROM pb LEFT JOIN vb ON pb.seq = vb.seq)
"""


#: As catalog.large_patterns: a pattern for each event.
_PATTERNS = f"""pat AS (SELECT event_id,
  substr(lower({_HOSTS_CASE}), event_id % 5 + 1, user_id % 9 + 1) || CASE WHEN event_id % 7 = 0 THEN '' ELSE event_id::VARCHAR END AS text
  FROM events)"""


_SECTION = ", ".join(f"CAST({x} AS BIGINT) AS {k}" for k, x in [
    ("packets", "count(*)"), ("bytes", "sum(packet_bytes)"),
    ("tcp_packets", "count(*) FILTER (WHERE is_parsed AND protocol = 6)"),
    ("udp_packets", "count(*) FILTER (WHERE is_parsed AND protocol = 17)"),
    ("forwarded", "count(*) FILTER (WHERE NOT blocked)"), ("dropped", "count(*) FILTER (WHERE blocked)"),
    ("first_seq", "min(seq)")])


def _ipfmt(c: str) -> str:
    return (f"(({c} >> 24) & 255)::VARCHAR || '.' || (({c} >> 16) & 255)::VARCHAR || '.' || "
            f"(({c} >> 8) & 255)::VARCHAR || '.' || ({c} & 255)::VARCHAR")


def _flows(src: str = "vb") -> str:
    """Final state per flow, from the running state of the last packet."""
    return f"""fl AS (SELECT capture_id, src_ip, dst_ip, src_port, dst_port, protocol,
    count(*) AS packet_count, sum(packet_bytes) AS byte_count,
    arg_max(app_state, seq) AS app, arg_max(host_state, seq) AS host, bool_or(blocked) AS blocked,
    min(seq) AS first_seq
  FROM {src} GROUP BY ALL)"""


def _pct(count: str, total: str) -> str:
    raw = f"(CASE WHEN {total} > 0 THEN CAST({count} AS DOUBLE) * 100.0 / CAST({total} AS DOUBLE) ELSE 0.0 END)"
    return raw


def _breakdown(counts_cte: str) -> str:
    """counts(capture_id, app, count) incl. NULL-app rows -> breakdown."""
    pct = _pct("count", "total")
    return f"""tot AS (SELECT capture_id, sum(count) AS total FROM {counts_cte} GROUP BY capture_id),
bd AS (SELECT c.capture_id, c.app, CAST(c.count AS BIGINT) AS count,
    CAST(floor({pct} * 10.0 + 0.5) AS DOUBLE) / 10.0 AS percentage,
    c.app IN ('YouTube') AS blocked,
    repeat('#', CAST(least(20, floor({pct} / 5.0 + 0.5)) AS INTEGER)) AS bar
  FROM {counts_cte} c JOIN tot t ON c.capture_id = t.capture_id WHERE c.app IS NOT NULL)"""


def _packet_counts() -> str:
    return """pc AS (SELECT capture_id, app_state AS app, count(*) AS count FROM allv GROUP BY ALL)"""


def _flow_counts() -> str:
    return _flows() + """,
fc AS (SELECT capture_id, app, sum(packet_count) AS count FROM fl GROUP BY ALL
       UNION ALL
       SELECT capture_id, NULL AS app, count(*) AS count FROM allv WHERE NOT is_parsed GROUP BY ALL)"""


def _totals() -> str:
    return """tt AS (SELECT capture_id, CAST(count(*) AS BIGINT) AS total_packets,
    CAST(sum(packet_bytes) AS BIGINT) AS total_bytes,
    CAST(count(*) FILTER (WHERE is_parsed AND protocol = 6) AS BIGINT) AS tcp_packets,
    CAST(count(*) FILTER (WHERE is_parsed AND protocol = 17) AS BIGINT) AS udp_packets,
    CAST(count(*) FILTER (WHERE NOT blocked) AS BIGINT) AS forwarded,
    CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS dropped
  FROM allv GROUP BY capture_id)"""


def _packet_hosts() -> str:
    return """ph AS (SELECT capture_id, host_state AS host, app_state AS app,
    CAST(min(seq) AS BIGINT) AS first_seq FROM vb WHERE host_state <> '' GROUP BY ALL)"""


def _apps_text(src: str) -> str:
    return f"""apt AS (SELECT capture_id,
    string_agg(app || ':' || CAST(count AS VARCHAR) || ':' || CAST(percentage AS VARCHAR) || ':' ||
               CAST(blocked AS VARCHAR), ';' ORDER BY count DESC, app) AS apps
  FROM {src} GROUP BY capture_id)"""


def _report(layout: str) -> str:
    return base(layout) + ", " + _totals() + ", " + _packet_counts() + ", " + _breakdown("pc") + \
        ", " + _packet_hosts() + ", " + _apps_text("bd") + """,
nh AS (SELECT capture_id, count(*) AS n FROM ph GROUP BY capture_id)
SELECT tt.capture_id, total_packets, total_bytes, tcp_packets, udp_packets, forwarded, dropped,
  CAST(0 AS BIGINT) AS processing_time_ms, coalesce(apt.apps, '') AS apps,
  CAST(coalesce(nh.n, 0) AS BIGINT) AS detected_hosts
FROM tt LEFT JOIN apt ON tt.capture_id = apt.capture_id LEFT JOIN nh ON tt.capture_id = nh.capture_id"""


def _json_lines() -> str:
    pct_txt = "CAST(percentage AS VARCHAR)"
    return base("single") + ", " + _totals() + ", " + _packet_counts() + ", " + _breakdown("pc") + \
        ", " + _packet_hosts() + f""",
ra AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY count DESC, app) AS rk FROM bd),
hf AS (SELECT *, first_seq = min(first_seq) OVER (PARTITION BY capture_id) AS is_first FROM ph),
na AS (SELECT tt.capture_id, (SELECT count(*) FROM bd WHERE bd.capture_id = tt.capture_id) AS n_apps,
          (SELECT count(*) FROM ph WHERE ph.capture_id = tt.capture_id) AS n_hosts FROM tt),
lines AS (
  SELECT capture_id, 0 AS section, 0 AS ord, 0 AS k, '{{' AS line FROM tt
  UNION ALL SELECT capture_id, 0, 0, 1, '  "totalPackets" : ' || total_packets || ',' FROM tt
  UNION ALL SELECT capture_id, 0, 0, 2, '  "totalBytes" : ' || total_bytes || ',' FROM tt
  UNION ALL SELECT capture_id, 0, 0, 3, '  "tcpPackets" : ' || tcp_packets || ',' FROM tt
  UNION ALL SELECT capture_id, 0, 0, 4, '  "udpPackets" : ' || udp_packets || ',' FROM tt
  UNION ALL SELECT capture_id, 0, 0, 5, '  "forwarded" : ' || forwarded || ',' FROM tt
  UNION ALL SELECT capture_id, 0, 0, 6, '  "dropped" : ' || dropped || ',' FROM tt
  UNION ALL SELECT capture_id, 0, 0, 7, '  "processingTimeMs" : 0,' FROM tt
  UNION ALL SELECT capture_id, 1, rk, 0, CASE WHEN rk = 1 THEN '  "appBreakdown" : [ {{' ELSE '  }}, {{' END FROM ra
  UNION ALL SELECT capture_id, 1, rk, 1, '    "appType" : ' || to_json(app) || ',' FROM ra
  UNION ALL SELECT capture_id, 1, rk, 2, '    "count" : ' || count || ',' FROM ra
  UNION ALL SELECT capture_id, 1, rk, 3, '    "percentage" : ' || {pct_txt} || ',' FROM ra
  UNION ALL SELECT capture_id, 1, rk, 4, '    "blocked" : ' || CAST(blocked AS VARCHAR) || ',' FROM ra
  UNION ALL SELECT capture_id, 1, rk, 5, '    "bar" : ' || to_json(bar) FROM ra
  UNION ALL SELECT capture_id, 2, 0, 0,
      CASE WHEN n_apps > 0 THEN '  }} ],' ELSE '  "appBreakdown" : [ ],' END FROM na
  UNION ALL SELECT capture_id, 3, first_seq, 0,
      CASE WHEN is_first THEN '  "detectedSnis" : [ {{' ELSE '  }}, {{' END FROM hf
  UNION ALL SELECT capture_id, 3, first_seq, 1, '    "sni" : ' || to_json(host) || ',' FROM hf
  UNION ALL SELECT capture_id, 3, first_seq, 2, '    "appType" : ' || to_json(app) FROM hf
  UNION ALL SELECT capture_id, 4, 0, 0,
      CASE WHEN n_hosts > 0 THEN '  }} ]' ELSE '  "detectedSnis" : [ ]' END FROM na
  UNION ALL SELECT capture_id, 5, 0, 0, '}}' FROM tt)
SELECT capture_id, CAST(section AS INTEGER) AS section, CAST(ord AS BIGINT) AS ord, CAST(k AS BIGINT) AS k, line FROM lines"""


def _csv_lines() -> str:
    return base("single") + ", " + _totals() + ", " + _packet_counts() + ", " + _breakdown("pc") + \
        ", " + _packet_hosts() + """,
ra AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY count DESC, app) AS rk FROM bd),
lines AS (
  SELECT capture_id, 0 AS section, 0 AS ord, 0 AS k, 'Metric,Value' AS line FROM tt
  UNION ALL SELECT capture_id, 0, 0, 1, 'Total Packets,' || total_packets FROM tt
  UNION ALL SELECT capture_id, 0, 0, 2, 'Total Bytes,' || total_bytes FROM tt
  UNION ALL SELECT capture_id, 0, 0, 3, 'TCP Packets,' || tcp_packets FROM tt
  UNION ALL SELECT capture_id, 0, 0, 4, 'UDP Packets,' || udp_packets FROM tt
  UNION ALL SELECT capture_id, 0, 0, 5, 'Forwarded,' || forwarded FROM tt
  UNION ALL SELECT capture_id, 0, 0, 6, 'Dropped,' || dropped FROM tt
  UNION ALL SELECT capture_id, 0, 0, 7, 'Processing Time (ms),0' FROM tt
  UNION ALL SELECT capture_id, 1, 0, 0, '' FROM tt
  UNION ALL SELECT capture_id, 1, 0, 1, 'Application,Count,Percentage,Blocked' FROM tt
  UNION ALL SELECT capture_id, 1, rk, 0, app || ',' || count || ',' || CAST(percentage AS VARCHAR)
      || ',' || CAST(blocked AS VARCHAR) FROM ra
  UNION ALL SELECT capture_id, 2, 0, 0, '' FROM tt
  UNION ALL SELECT capture_id, 2, 0, 1, 'SNI,Application' FROM tt
  UNION ALL SELECT capture_id, 3, first_seq, 0, host || ',' || app FROM ph)
SELECT capture_id, CAST(section AS INTEGER) AS section, CAST(ord AS BIGINT) AS ord, CAST(k AS BIGINT) AS k, line FROM lines"""


def _rules_validate() -> str:
    labels = ("CASE upper(value) WHEN 'UNKNOWN' THEN 'UNKNOWN' WHEN 'HTTP' THEN 'HTTP' "
              "WHEN 'HTTPS' THEN 'HTTPS' WHEN 'DNS' THEN 'DNS' WHEN 'YOUTUBE' THEN 'YouTube' "
              "WHEN 'FACEBOOK' THEN 'Facebook' WHEN 'GOOGLE' THEN 'Google' "
              "WHEN 'TWITTER' THEN 'Twitter' WHEN 'NETFLIX' THEN 'Netflix' "
              "WHEN 'TIKTOK' THEN 'TikTok' WHEN 'GITHUB' THEN 'GitHub' WHEN 'AMAZON' THEN 'Amazon' END")
    names = ("['unknown','http','https','dns','youtube','facebook','google','twitter',"
             "'netflix','tiktok','github','amazon']")
    return f"""WITH r AS (
  SELECT DISTINCT 'ip' AS rule_type, '192.168.1.' || user_id AS value FROM events
  UNION SELECT DISTINCT 'ip', user_id || '.' || user_id FROM events WHERE user_id % 10 = 0
  UNION SELECT DISTINCT 'app', event_type FROM events
  UNION SELECT DISTINCT 'app', {names}[user_id % 12 + 1] FROM events
  UNION SELECT DISTINCT 'domain', {_HOSTS_CASE} FROM events WHERE event_type IN ('view','click')),
e AS (SELECT *, CASE
    WHEN rule_type = 'ip' AND len(string_split(value, '.')) < 4 THEN 'fewer than four parts'
    WHEN rule_type = 'app' AND {labels} IS NULL THEN 'unknown app: ' || value END AS error FROM r)
SELECT rule_type, value,
  CASE WHEN rule_type = 'ip' AND error IS NULL THEN CAST(3232235776 + CAST(split_part(value, '.', 4) AS BIGINT) % 256 AS BIGINT) END AS ip,
  CASE WHEN rule_type = 'app' AND error IS NULL THEN {labels} END AS app,
  CASE WHEN rule_type = 'domain' THEN lower(value) END AS domain,
  error
FROM e"""


def _q(body: str, layout: str = "single", ctes: str = "") -> str:
    return base(layout) + ctes + " " + body


def oracle_sql() -> dict[str, str]:
    kw_case = """CASE WHEN host IS NULL OR host = '' THEN NULL
      WHEN contains(lower(host), 'tube') OR contains(lower(host), 'video') THEN 'Video'
      WHEN contains(lower(host), 'google') THEN 'Search'
      WHEN contains(lower(host), 'git') THEN 'Code'
      WHEN contains(lower(host), '.com') THEN 'Dotcom'
      WHEN contains(lower(host), 'www') THEN 'Web' END"""
    rule_ip_set = ("(SELECT DISTINCT 3232235776 + user_id AS ip FROM events WHERE user_id % 7 = 0)")
    q = {
        "traffic_totals": _q(", " + _totals() + " SELECT * FROM tt"),
        "decode_gate": _q("SELECT CAST(seq AS BIGINT) AS seq, is_parsed, "
                          "CAST(packet_bytes AS BIGINT) AS packet_bytes FROM pb"),
        "decode_headers": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, CAST(protocol AS BIGINT) AS protocol, "
            "CAST(20 AS BIGINT) AS ip_header_len, CAST(l4_header_len AS BIGINT) AS l4_header_len, "
            "CAST(wire_src_ip AS BIGINT) AS wire_src_ip, CAST(wire_dst_ip AS BIGINT) AS wire_dst_ip, "
            "CAST(wire_src_port AS BIGINT) AS wire_src_port, "
            "CAST(wire_dst_port AS BIGINT) AS wire_dst_port FROM pb WHERE is_parsed"),
        "payload_stats": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, CAST(34 + l4_header_len AS BIGINT) AS payload_offset, "
            "CAST(payload_len AS BIGINT) AS payload_len, payload_len > 0 AS has_payload "
            "FROM pb WHERE is_parsed"),
        "flow_key": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, CAST(src_ip AS BIGINT) AS src_ip, "
            "CAST(dst_ip AS BIGINT) AS dst_ip, CAST(src_port AS BIGINT) AS src_port, "
            "CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol "
            "FROM pb WHERE is_parsed"),
        "ip_format": _q(
            f"SELECT CAST(seq AS BIGINT) AS seq, {_ipfmt('src_ip')} AS src_ip_text, "
            f"{_ipfmt('dst_ip')} AS dst_ip_text FROM pb WHERE is_parsed"),
        "ip_parse": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, "
            "((wire_src_ip >> 24) & 255)::VARCHAR || '.' || ((wire_src_ip >> 16) & 255)::VARCHAR || '.' || "
            "((wire_src_ip >> 8) & 255)::VARCHAR || '.' || ((wire_src_ip & 255) + 256 * (seq % 2))::VARCHAR "
            "|| CASE WHEN seq % 3 = 0 THEN '.7' ELSE '' END AS ip_text, "
            "CAST(wire_src_ip AS BIGINT) AS ip FROM pb WHERE is_parsed"),
        "flow_label": _q(
            f"SELECT CAST(seq AS BIGINT) AS seq, {_ipfmt('src_ip')} || ':' || src_port::VARCHAR || "
            f"' <-> ' || {_ipfmt('dst_ip')} || ':' || dst_port::VARCHAR || ' proto=' || "
            f"protocol::VARCHAR AS flow_label FROM pb WHERE is_parsed"),
        "bypass_packets": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, CAST(packet_bytes AS BIGINT) AS packet_bytes, "
            "CASE WHEN kind = 'arp' THEN '0806' ELSE '0800' END AS ethertype FROM pb WHERE NOT is_parsed"),
        "sni_extract": _q("SELECT CAST(seq AS BIGINT) AS seq, sni FROM h WHERE sni IS NOT NULL"),
        "http_host_extract": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, http_host FROM h WHERE http_host IS NOT NULL"),
        "host_per_packet": _q("SELECT CAST(seq AS BIGINT) AS seq, host FROM h WHERE host IS NOT NULL"),
        "classify_keyword": _q("SELECT CAST(seq AS BIGINT) AS seq, named FROM n"),
        "classify_port": _q("SELECT CAST(seq AS BIGINT) AS seq, port_app FROM n"),
        "classify_packet": _q("SELECT CAST(seq AS BIGINT) AS seq, coalesce(named, port_app) AS app FROM n"),
        "classify_keyword_table": _q(f"SELECT CAST(seq AS BIGINT) AS seq, {kw_case} AS named FROM n"),
        "app_label": _q("SELECT CAST(seq AS BIGINT) AS seq, upper(app_state) AS app_name, "
                        "app_state AS label FROM v"),
        "rules_validate": _rules_validate(),
        "rule_ip": _q(
            f"SELECT CAST(seq AS BIGINT) AS seq, src_ip IN {rule_ip_set} AS ip_low, "
            f"(src_ip IN {rule_ip_set} OR dst_ip IN {rule_ip_set}) AS ip_either FROM v"),
        "rule_app": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, app_state, "
            "app_state IN ('YouTube', 'DNS', 'GitHub') AS app_hit FROM v"),
        "rule_domain": _q(
            "SELECT CAST(seq AS BIGINT) AS seq, host_state, coalesce(host_state <> '' AND ("
            + " OR ".join(f"contains(lower(host_state), '{d.lower()}')" for d in DOMAIN_RULES_MIXED)
            + "), false) AS dom_hit FROM v"),
        "rule_domain_large": _q(
            "SELECT CAST(v.seq AS BIGINT) AS seq, host_state, hits.h IS NOT NULL AS dom_hit FROM v LEFT JOIN hits ON v.host_state = hits.h",
            ctes=f", {_PATTERNS}, hits AS (SELECT DISTINCT h FROM (SELECT DISTINCT host_state AS h FROM v WHERE host_state <> '') JOIN "
                 "(SELECT DISTINCT text FROM pat WHERE length(text) >= 4) ON contains(lower(h), text))"),
        "classify_keyword_large": _q(
            "SELECT CAST(n.seq AS BIGINT) AS seq, best.app AS named FROM n LEFT JOIN best ON n.host = best.h",
            ctes=f", {_PATTERNS}, best AS (SELECT h, min_by('class ' || (event_id % 50), (event_id % 1000, text, 'class ' || (event_id % 50))) AS app "
                 "FROM (SELECT DISTINCT host AS h FROM n WHERE host <> '') JOIN pat ON length(text) > 2 AND contains(lower(h), text) GROUP BY h)"),
        "rules_many_captures": _q(
            "SELECT a.capture_id, CAST(a.seq AS BIGINT) AS seq, coalesce(i OR p OR d, false) AS blocked, "
            "CASE WHEN i THEN 'ip' WHEN p THEN 'app' WHEN d THEN 'domain' END AS block_reason FROM allv a LEFT JOIN hit ON hit.seq = a.seq",
            "daily",
            ctes=", days AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events), "
                 "hit AS (SELECT seq, EXISTS (SELECT 1 FROM days WHERE event_id % 40 = 0 AND day = v.capture_id AND 3232235776 + user_id = v.src_ip) AS i, "
                 "app_state = 'GitHub' AND EXISTS (SELECT 1 FROM days WHERE event_id % 900 = 0 AND day = v.capture_id) AS p, "
                 "coalesce(EXISTS (SELECT 1 FROM days WHERE event_id % 700 = 0 AND day = v.capture_id "
                 "AND contains(lower(v.host_state), 'goo' || substr('gle', 1, event_id % 3 + 1))), false) AS d FROM v)"),
        "app_state": _q("SELECT CAST(seq AS BIGINT) AS seq, app_state FROM v"),
        "host_state": _q("SELECT CAST(seq AS BIGINT) AS seq, host_state FROM v"),
        "flow_running": _q("SELECT CAST(seq AS BIGINT) AS seq, CAST(flow_packets AS BIGINT) AS flow_packets, "
                           "CAST(flow_bytes AS BIGINT) AS flow_bytes FROM v"),
        "verdicts": _q("SELECT CAST(seq AS BIGINT) AS seq, is_parsed, app_state, host_state, blocked, "
                       "block_reason FROM allv"),
        "verdict_totals": _q(
            "SELECT capture_id, CAST(count(*) FILTER (WHERE NOT blocked) AS BIGINT) AS forwarded, "
            "CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS dropped, "
            "CAST(count(*) FILTER (WHERE block_reason = 'ip') AS BIGINT) AS dropped_ip, "
            "CAST(count(*) FILTER (WHERE block_reason = 'app') AS BIGINT) AS dropped_app, "
            "CAST(count(*) FILTER (WHERE block_reason = 'domain') AS BIGINT) AS dropped_domain "
            "FROM allv GROUP BY capture_id"),
        "packets_with_flow": _q(
            ", z AS (SELECT seq, count(*) OVER f AS c, sum(packet_bytes) OVER f AS b, "
            "last_value(app_state) OVER f AS a, last_value(host_state) OVER f AS hs FROM v "
            "WINDOW f AS (PARTITION BY capture_id, src_ip, dst_ip, src_port, dst_port, protocol "
            "ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) "
            "SELECT CAST(seq AS BIGINT) AS seq, CAST(c AS BIGINT) AS flow_packet_count, "
            "CAST(b AS BIGINT) AS flow_byte_count, a AS flow_app, hs AS flow_host FROM z"),
        "forwarded_packets": _q("SELECT CAST(seq AS BIGINT) AS seq, CAST(packet_bytes AS BIGINT) AS incl_len "
                                "FROM allv WHERE NOT blocked"),
        "dropped_packets": _q("SELECT CAST(seq AS BIGINT) AS seq, CAST(packet_bytes AS BIGINT) AS incl_len "
                              "FROM allv WHERE blocked"),
        "flow_table": _q(", " + _flows() + " SELECT capture_id, CAST(src_ip AS BIGINT) AS src_ip, "
                         "CAST(dst_ip AS BIGINT) AS dst_ip, CAST(src_port AS BIGINT) AS src_port, "
                         "CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol, "
                         "CAST(packet_count AS BIGINT) AS packet_count, "
                         "CAST(byte_count AS BIGINT) AS byte_count, app, host, blocked FROM fl"),
        "app_breakdown_packet": _q(", " + _packet_counts() + ", " + _breakdown("pc") + " SELECT * FROM bd"),
        "app_breakdown_flow": _q(", " + _flow_counts() + ", " + _breakdown("fc") + " SELECT * FROM bd"),
        "detected_hosts_packet": _q(", " + _packet_hosts() + " SELECT * FROM ph"),
        "detected_hosts_flow": _q(", " + _flows() + " SELECT capture_id, host, app, "
                                  "CAST(min(first_seq) AS BIGINT) AS first_seq FROM fl "
                                  "WHERE host <> '' GROUP BY ALL"),
        "report_one_pass": _q(
            "SELECT 'total' AS section, capture_id, NULL::VARCHAR AS app, NULL::VARCHAR AS host, " + _SECTION + " FROM allv GROUP BY ALL UNION ALL "
            "SELECT 'app', capture_id, app_state, NULL, " + _SECTION + " FROM allv WHERE is_parsed GROUP BY ALL UNION ALL "
            "SELECT 'host', capture_id, app_state, host_state, " + _SECTION + " FROM allv WHERE is_parsed AND host_state <> '' GROUP BY ALL", "daily"),
        "report_per_capture": _report("daily"),
        "traffic_report": _report("single"),
        "report_csv_lines": _csv_lines(),
        "report_json": _json_lines(),
        "pcap_scan": _q(
            "SELECT capture_id, CAST(count(*) AS BIGINT) AS total_packets, "
            "CAST(sum(packet_bytes) AS BIGINT) AS total_bytes, "
            "CAST(count(*) FILTER (WHERE is_parsed AND protocol = 6) AS BIGINT) AS tcp_packets, "
            "CAST(count(*) FILTER (WHERE is_parsed AND protocol = 17) AS BIGINT) AS udp_packets "
            "FROM pb GROUP BY capture_id", "daily"),
        "pcap_scan_split": _q(
            "SELECT capture_id, CAST(ts_sec AS BIGINT) AS ts_sec, CAST(ts_usec AS BIGINT) AS ts_usec, "
            "CAST(packet_bytes AS BIGINT) AS packet_bytes, CAST(1 AS BIGINT) AS of_this_seq FROM pb"),
        "stream_tail": _q(
            "SELECT capture_id, CAST(ts_sec AS BIGINT) AS ts_sec, CAST(ts_usec AS BIGINT) AS ts_usec, "
            "CAST(packet_bytes AS BIGINT) AS packet_bytes, CAST(1 AS BIGINT) AS of_this_seq FROM pb"),
        "pcap_permissive": _q(
            "SELECT capture_id, CAST(count(*) FILTER (WHERE ts_sec % 61 <> 7) AS BIGINT) AS packets, "
            "CAST(sum(packet_bytes) FILTER (WHERE ts_sec % 61 <> 7) AS BIGINT) AS bytes, "
            "CAST(coalesce(sum(16 + packet_bytes) FILTER (WHERE ts_sec % 61 = 7), 0) AS BIGINT) AS lost_bytes "
            "FROM pb GROUP BY capture_id", "daily"),
        "pcap_roundtrip": _q(
            "SELECT CAST(ts_sec AS BIGINT) AS ts_sec, CAST(ts_usec AS BIGINT) AS ts_usec, "
            "CAST(packet_bytes AS BIGINT) AS incl_len, CAST(packet_bytes AS BIGINT) AS orig_len "
            "FROM allv WHERE NOT blocked"),
        "stream_ingest": _q(
            "SELECT capture_id, CAST(count(*) AS BIGINT) AS packets, "
            "CAST(sum(packet_bytes) AS BIGINT) AS bytes, "
            "CAST(count(*) FILTER (WHERE is_parsed) AS BIGINT) AS parsed FROM pb GROUP BY capture_id",
            "daily"),
        "stream_verdicts": _q("SELECT CAST(seq AS BIGINT) AS seq, is_parsed, app_state, host_state, blocked, "
                              "block_reason FROM allv"),
        "stream_verdicts_shuffled": _q(
            "SELECT CAST(a.seq AS BIGINT) AS seq, a.is_parsed, a.app_state, a.host_state, CAST(v.flow_packets AS BIGINT) AS flow_packets, "
            "CAST(v.flow_bytes AS BIGINT) AS flow_bytes, a.blocked, a.block_reason FROM allv a LEFT JOIN v ON a.seq = v.seq"),
        "stream_forward": _q(
            "SELECT blocked AS dropped, CAST(ts_sec AS BIGINT) AS ts_sec, CAST(ts_usec AS BIGINT) AS ts_usec, "
            "CAST(packet_bytes AS BIGINT) AS incl_len, CAST(packet_bytes AS BIGINT) AS orig_len, "
            "CAST(row_number() OVER (PARTITION BY blocked ORDER BY seq) AS BIGINT) AS place FROM allv"),
        "stream_flow_evictions": _q(
            "SELECT capture_id, CAST(src_ip AS BIGINT) AS src_ip, CAST(dst_ip AS BIGINT) AS dst_ip, CAST(src_port AS BIGINT) AS src_port, "
            "CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol, CAST(count(*) AS BIGINT) AS packet_count, "
            "CAST(sum(packet_bytes) AS BIGINT) AS byte_count, CASE WHEN any_value(port_app) = 'DNS' "
            "THEN coalesce(first(named ORDER BY seq), 'DNS') ELSE coalesce(arg_min(named, seq), any_value(port_app)) END AS app, "
            "arg_max(host, seq) AS host, CAST(min(us) AS BIGINT) AS first_us, CAST(max(us) AS BIGINT) AS last_us FROM life "
            "GROUP BY capture_id, src_ip, dst_ip, src_port, dst_port, protocol, k "
            "HAVING max(us) + 172800000000 <= (SELECT max(us) // 1000 * 1000 FROM life)",
            ctes=", timed AS (SELECT *, ts_sec * 1000000 + ts_usec AS us FROM n), "
                 "gaps AS (SELECT *, coalesce(us - lag(us) OVER f > 172800000000, false) AS fresh FROM timed "
                 "WINDOW f AS (PARTITION BY capture_id, src_ip, dst_ip, src_port, dst_port, protocol ORDER BY us)), "
                 "life AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY capture_id, src_ip, dst_ip, src_port, dst_port, protocol ORDER BY us) AS k FROM gaps)"),
        "stream_rules_large": _q(
            "SELECT CAST(a.seq AS BIGINT) AS seq, host_state, hits.h IS NOT NULL AS blocked FROM allv a LEFT JOIN hits ON a.host_state = hits.h",
            ctes=f", {_PATTERNS}, hits AS (SELECT DISTINCT h FROM (SELECT DISTINCT host_state AS h FROM v WHERE host_state <> '') JOIN "
                 "(SELECT DISTINCT text FROM pat WHERE length(text) >= 4) ON contains(lower(h), text))"),
        "stream_flow_upsert": _q(", " + _flows() + " SELECT capture_id, CAST(src_ip AS BIGINT) AS src_ip, "
                         "CAST(dst_ip AS BIGINT) AS dst_ip, CAST(src_port AS BIGINT) AS src_port, "
                         "CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol, "
                         "CAST(packet_count AS BIGINT) AS packet_count, "
                         "CAST(byte_count AS BIGINT) AS byte_count, app, host, blocked FROM fl"),
        "stream_flow_table": _q(
            ", " + _flows() + " SELECT capture_id, CAST(src_ip AS BIGINT) AS src_ip, "
            "CAST(dst_ip AS BIGINT) AS dst_ip, CAST(src_port AS BIGINT) AS src_port, "
            "CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol, "
            "CAST(packet_count AS BIGINT) AS packet_count, CAST(byte_count AS BIGINT) AS byte_count, "
            "app, host FROM fl"),
        "capture_inventory": _q(
            "SELECT capture_id, 'little' AS byte_order, '2.4' AS version, "
            "CAST(65535 AS BIGINT) AS snaplen, CAST(1 AS BIGINT) AS link_type, "
            "CAST(count(*) AS BIGINT) AS n_packets, CAST(sum(packet_bytes) AS BIGINT) AS n_bytes, "
            "CAST(0 AS BIGINT) AS errors FROM pb GROUP BY capture_id", "daily"),
        "stream_totals": _q(", " + _totals() + " SELECT * FROM tt"),
    }
    return q

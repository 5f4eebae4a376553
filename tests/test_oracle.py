"""A subset of the registered queries against their DuckDB oracle at
sf0.001 (the driver checks all of them at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
KEYS = ["traffic_totals", "decode_headers", "sni_extract", "http_host_extract", "classify_packet",
        "classify_keyword_table", "rules_validate", "rule_ip", "rule_domain", "verdicts",
        "flow_table", "app_breakdown_flow", "detected_hosts_packet", "report_json",
        "report_csv_lines", "report_per_capture", "pcap_roundtrip", "stream_verdicts",
        "stream_verdicts_shuffled", "stream_flow_evictions"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ["events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as se
    from oracle_check import rows_of
    df = se.queries()[key](spark, SF)
    rel = duck.sql(se.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())

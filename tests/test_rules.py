"""Rule loading and matching."""

import pandas as pd
import pytest

from wirelens.functions.ip import ip_format, ip_parse
from wirelens.operators.rules import apply_rules, load_rules, rules_frame, validate_rules


def test_ip_parse_lenient(spark):
    df = spark.createDataFrame([("256.0.0.1",), ("1.2.3.4.5",), ("1.2.3",), ("a.b.c.d",),
                                ("10.0.0.1",)], "t string")
    got = [r.ip for r in df.select(ip_parse("t").alias("ip")).collect()]
    assert got == [1, (1 << 24) + (2 << 16) + (3 << 8) + 4, None, None, (10 << 24) + 1]
    assert df.select(ip_format(ip_parse("t")).alias("x")).collect()[4].x == "10.0.0.1"


def test_load_rules_rejects(spark):
    rules, rejects = load_rules(spark, ips=["1.2.3"], apps=["myspace", "youtube", "Dns"])
    assert sorted(r.app for r in rules.collect()) == ["DNS", "YouTube"]
    assert sorted(r.error for r in rejects.collect()) == ["fewer than four parts",
                                                          "unknown app: myspace"]
    with pytest.raises(ValueError):
        load_rules(spark, ips=["1.2.3"], strict=True)


def _packets(spark):
    rows = [dict(capture_id=cap, seq=i, src_ip=ip, dst_ip=ip + 1000, app_state=app,
                 host_state=host, is_parsed=True)
            for i, (cap, ip, app, host) in enumerate([
                ("a", 10, "YouTube", "www.youtube.com"), ("a", 11, "HTTPS", ""),
                ("b", 12, "UNKNOWN", "Mail.Example.ORG"), ("b", 1010, "UNKNOWN", None),
                ("a", 13, "DNS", "x%y_z.net"), ("b", 14, "GitHub", "github.com")])]
    return spark.createDataFrame(pd.DataFrame(rows))


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_rules_by_broadcast_and_merge_joins(spark, broadcast):
    from wirelens.schemas import RULES
    raw = spark.createDataFrame([
        ("ip", "0.0.0.11", None), ("ip", "0.0.0.14", "a"), ("ip", "0.0.0.10", "b"),
        ("ip", "0.0.7.218", None),                       # 2010: only a destination
        ("app", "dns", None), ("domain", "EXAMPLE", None), ("domain", "%y_", None),
        ("domain", "hub", "b")], RULES)
    rules, _ = validate_rules(raw)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r.seq: (r.blocked, r.block_reason) for r in
               apply_rules(_packets(spark), rules).collect()}
        either = {r.seq: r.blocked for r in
                  apply_rules(_packets(spark), rules, ip_match="either").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: (False, None), 1: (True, "ip"), 2: (True, "domain"), 3: (False, None),
                   4: (True, "app"), 5: (True, "domain")}
    assert either == {0: False, 1: True, 2: True, 3: True, 4: True, 5: True}


def test_rarest_gram_index_equals_every_pair(spark):
    """Any number of lengths, patterns of one and two characters, the empty
    one, patterns none of whose grams occur, nulls and other alphabets."""
    import random

    from wirelens.operators.substrings import substring_matches
    r = random.Random(3)
    texts = sorted({"".join(r.choice("ab.é漢%_") for _ in range(r.randint(1, 12))) for _ in range(80)}) + ["", None, "x" * 300]
    pats = sorted({"".join(r.choice("ab.é漢%_") for _ in range(r.randint(0, 5))) for _ in range(120)}) + ["zzz", None, "x" * 5000, "x" * 7, texts[0]]
    got = substring_matches(spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "t string, tk int"), "t",
                            spark.createDataFrame([(p, k) for k, p in enumerate(pats)], "p string, pk int"), "p")
    want = sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(pats) if t and p is not None and p in t)
    assert sorted((x.tk, x.pk) for x in got.collect()) == want and len(want) > 200


def test_more_lengths_than_any_bound(spark):
    """Patterns of 5,000 lengths."""
    from wirelens.operators.substrings import substring_matches
    pats = spark.range(1, 5001).selectExpr("repeat('ab', cast(id as int)) AS p")
    texts = spark.createDataFrame([("ab" * 40 + "c",)], "t string")
    assert substring_matches(texts, "t", pats, "p").count() == 40


def test_packets_without_host_are_spread(spark):
    """In a merge join packets without a host don't share a key."""
    from wirelens.operators.rules import rule_flags
    rules, _ = load_rules(spark, domains=["facebook"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = rule_flags(_packets(spark), rules)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchange = p.split("hashpartitioning(lower(host_state")[1]
    assert "SortMergeJoin" in p and "ELSE xxhash64(capture_id" in exchange[:150]


def test_empty_domain_rule_matches_non_empty_hosts(spark):
    rules, _ = load_rules(spark, domains=[""])
    got = {r.seq: r.blocked for r in apply_rules(_packets(spark), rules).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True}


def test_rules_frame_schema(spark):
    assert rules_frame(spark, ips=["1.1.1.1"]).columns == ["rule_type", "value", "capture_id"]

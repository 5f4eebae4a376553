"""Hosts that a stream has tried on its rules."""

import pytest

from wirelens.operators import rules as R
from wirelens.streaming.state import verdict_batch

COLUMNS = "capture_id string, src_ip bigint, seq bigint, app_state string, host_state string, is_parsed boolean"


def _batch(spark, hosts):
    return spark.createDataFrame([(cap, 1, i, "HTTP", h, True) for i, (cap, h) in enumerate(hosts)], COLUMNS)


@pytest.mark.parametrize("per_capture", [False, True])
def test_a_host_is_tried_on_the_rules_once(spark, monkeypatch, per_capture):
    tried, counted = [], []
    hits, kinds = R._hits_among, R._kinds
    monkeypatch.setattr(R, "_hits_among", lambda texts, rules: tried.append(
        sorted((r[0] or "", r[1] or "") for r in texts.collect())) or hits(texts, rules))
    monkeypatch.setattr(R, "_kinds", lambda rules: counted.append(1) or kinds(rules))
    rules = R.load_rules(spark, domains=["bad", ""])[0].filter("domain <> ''")
    if per_capture:
        mine = R.load_rules(spark, domains=["good"], capture_id="b")[0]
        rules = rules.unionByName(mine)
    judge = verdict_batch(rules)
    batches = [[("a", "x.BAD"), ("a", "good"), ("b", "good"), ("a", None), ("a", "")], [("a", "x.bad"), ("a", "good"), ("a", None)],
               [("b", "new.bad"), ("b", "Good"), ("b", "other")], [("b", "other"), ("a", "good")]]
    for rows in batches:
        df = _batch(spark, rows)
        got = {r.seq: (r.blocked, r.block_reason) for r in judge(df).collect()}
        plain = {r.seq: (r.blocked, r.block_reason) for r in R.apply_rules(df, rules).collect()}
        expected = {}
        for i, (cap, h) in enumerate(rows):
            hit = "bad" in (h or "").lower() or (per_capture and cap == "b" and "good" in (h or "").lower())
            expected[i] = (hit, "domain" if hit else None)
        assert got == plain == expected
    first = [("", ""), ("", ""), ("", "good"), ("", "x.bad")]
    # apply_rules tries all hosts of each of the four tables, the stream those that are new in the first and third
    assert len(tried) == 6 and counted == [1] * 5
    if not per_capture:
        assert tried[0] == first and [("", "new.bad"), ("", "other")] in tried


def test_without_domain_rules_no_host_is_looked_at(spark, monkeypatch):
    monkeypatch.setattr(R, "_distinct_hosts", lambda *a: 1 / 0)
    judge = verdict_batch(R.load_rules(spark, apps=["youtube"])[0])
    assert [r.blocked for r in judge(_batch(spark, [("a", "x")])).collect()] == [False]

"""Per-flow state machine: a sequential machine vs the
scan over ranges (several piece sizes), the plain window form, the
aggregate form (flow table) and the streaming handler."""

import random

import pandas as pd
import pytest

from wirelens.operators import flows
from wirelens.operators.flows import flow_table, split_flows, with_flow_state, with_flow_state_window
from wirelens.schemas import FLOW_KEY
from wirelens.streaming.state import advance

OVERWRITABLE = {"UNKNOWN", "HTTP", "HTTPS"}
NAMED = ["YouTube", "Google", "Netflix", None, None, None]
HOSTS = ["a.com", "b.org", "", None, None, None, None]
PORTS = {443: "HTTPS", 80: "HTTP", 53: "DNS", 8080: "UNKNOWN"}


def simulate(rows):
    """The state rule, one packet after the other: a flow keeps a class that
    is neither unknown nor a bare port class; its host is the last one seen."""
    machines, states = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        m = machines.setdefault(tuple(r[c] for c in FLOW_KEY), dict(app=None, sni=None, n=0, b=0))
        if m["app"] is None or m["app"] in OVERWRITABLE:
            m["app"] = r["named"] or r["port_app"]
        m.update(n=m["n"] + 1, b=m["b"] + r["packet_bytes"], sni=m["sni"] if r["host"] is None else r["host"])
        states[r["seq"]] = (m["app"], m["sni"], m["n"], m["b"])
    return states, machines


def random_rows(seed, n=1500, flows=60):
    rnd = random.Random(seed)
    keys = []
    for i in range(flows):
        port = rnd.choice(list(PORTS))
        keys.append(("c", 100 + i % 7, 200 + i, 1000 + i, port, 6))
    seqs = list(range(n))
    rnd.shuffle(seqs)
    rows = []
    for s in seqs:
        k = keys[min(int(rnd.paretovariate(1.2)) - 1, flows - 1)]   # skewed: a few hot flows
        named = rnd.choice(NAMED)
        host = rnd.choice(HOSTS) if named is None else "x"
        rows.append(dict(zip(FLOW_KEY, k), seq=s, named=named, host=host,
                         port_app=PORTS[k[4]], packet_bytes=rnd.randint(40, 1500),
                         is_parsed=True))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_forms_equal_sequential(spark, seed):
    rows = random_rows(seed)
    expect, final = simulate(rows)
    df = spark.createDataFrame(pd.DataFrame(rows))
    for form in ("b7", "b97", "default", "window", "parts4", "parts400"):
        if form == "window":
            st = with_flow_state_window(df)
        elif form == "default":
            st = with_flow_state(df)
        elif form.startswith("parts"):
            st = with_flow_state(df, piece_rows=100, partitions=int(form[5:]))
        else:
            st = with_flow_state(df, piece_rows=int(form[1:]))
        got = {r.seq: (r.app_state, r.host_state, r.flow_packets, r.flow_bytes)
               for r in st.select("seq", "app_state", "host_state", "flow_packets",
                                  "flow_bytes").collect()}
        assert got == expect, form
    ft = {tuple(r[c] for c in FLOW_KEY): (r.app, r.host, r.packet_count, r.byte_count)
          for r in flow_table(df).collect()}
    assert ft == {k: (f["app"], f["sni"], f["n"], f["b"]) for k, f in final.items()}


def test_streaming_handler_equals_sequential():
    rows = random_rows(3, n=800, flows=20)
    expect, _ = simulate(rows)
    pdf = pd.DataFrame(rows).sort_values("seq")
    got = {}
    for _k, g in pdf.groupby(FLOW_KEY):
        g = g.reset_index(drop=True)
        state = None
        for part in (g.iloc[: len(g) // 3], g.iloc[len(g) // 3:]):   # two micro-batches
            if len(part) == 0:
                continue
            out, state = advance(part.reset_index(drop=True), state)
            for s, a, h, n, b in zip(part["seq"], out["app_state"], out["host_state"],
                                     out["flow_packets"], out["flow_bytes"]):
                got[s] = (a, h if isinstance(h, str) else None, int(n), int(b))
    assert got == expect


def test_dns_flow_sticky_and_domain_unblock(spark):
    from wirelens.operators.rules import apply_rules, load_rules
    base = dict(capture_id="c", src_ip=1, dst_ip=2, src_port=3, protocol=6, is_parsed=True,
                packet_bytes=60)
    rows = [
        dict(base, dst_port=53, seq=0, named=None, host=None, port_app="DNS"),
        dict(base, dst_port=53, seq=1, named="YouTube", host="youtube.com", port_app="DNS"),
        dict(base, dst_port=80, seq=2, named="Facebook", host="facebook.com", port_app="HTTP"),
        dict(base, dst_port=80, seq=3, named=None, host="other.org", port_app="HTTP"),
    ]
    st = with_flow_state(spark.createDataFrame(pd.DataFrame(rows)))
    rules, _ = load_rules(spark, domains=["facebook"])
    got = {r.seq: (r.app_state, r.blocked) for r in apply_rules(st, rules).collect()}
    assert got == {0: ("DNS", False), 1: ("DNS", False), 2: ("Facebook", True),
                   3: ("Facebook", False)}


def hot_rows(n=1200):
    """One flow holds a third of all packets."""
    rows = random_rows(5, n=n, flows=40)
    hot = dict(rows[0])
    for i, r in enumerate(rows):
        if i % 3 == 0:
            for k in FLOW_KEY + ["port_app"]:
                r[k] = hot[k]
    return rows, sum(1 for r in rows if all(r[k] == hot[k] for k in FLOW_KEY))


def test_hot_flow_is_split_and_exact(spark):
    """Pieces of a hot flow stay near ``piece_rows``, only cut flows have
    borders, and the running state is still exact."""
    rows, n_hot = hot_rows()
    assert n_hot >= 400
    expect, final = simulate(rows)
    df = spark.createDataFrame(pd.DataFrame(rows))
    st = with_flow_state(df, piece_rows=50)
    got = {r.seq: (r.app_state, r.host_state, r.flow_packets, r.flow_bytes)
           for r in st.select("seq", "app_state", "host_state", "flow_packets",
                              "flow_bytes").collect()}
    assert got == expect
    found = split_flows(df, 50)
    names = {r["h"]: tuple(r)[:-1] for r in df.select(*FLOW_KEY, flows._flow_hash().alias("h")).distinct().collect()}
    borders = {names[r["__flow"]]: r["borders"] for r in found.collect()}
    assert borders.keys() == {k for k, m in final.items() if m["n"] > 50}
    assert sum(map(len, borders.values())) <= len(rows) // 50
    for k, at in borders.items():
        mine = sorted(r["seq"] for r in rows if tuple(r[c] for c in FLOW_KEY) == k)
        pieces = [sum(a <= s < b for s in mine) for a, b in zip([-1, *at], [*at, 1 << 62])]
        assert max(pieces) <= 50 and min(pieces) > 0


def test_thinned_sample_cuts_near_the_size(spark):
    """With a thinned sample pieces are about the size asked for."""
    rows, n_hot = hot_rows(6000)
    df = spark.createDataFrame(pd.DataFrame(rows))
    sampled = flows.PIECE_SAMPLES
    flows.PIECE_SAMPLES = 40
    try:
        cut = split_flows(df, 400)  # one packet in ten
        (at,) = [r["borders"] for r in cut.collect() if len(r["borders"]) == max(len(x["borders"]) for x in cut.collect())]
        assert 2 <= len(at) <= n_hot // 300 and at == sorted(at)
        st = with_flow_state(df, piece_rows=400)
        expect, _ = simulate(rows)
        assert {r.seq: (r.app_state, r.host_state, r.flow_packets, r.flow_bytes) for r in st.collect()} == expect
    finally:
        flows.PIECE_SAMPLES = sampled

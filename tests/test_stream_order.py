"""Packets out of order over micro-batches, and flows evicted by event time."""

import os
import random

import pandas as pd
from test_flow_state import random_rows, simulate

from wirelens.schemas import FLOW_KEY
from wirelens.streaming import reorder
from wirelens.streaming.aggregates import run_to_table, stream_flow_evictions
from wirelens.streaming.reorder import OrderedStates, ReorderBuffer, run_in_order

PACKET = "capture_id string, seq long, note string"


def brute_release(epochs, patience=None):
    """The released packets of each epoch, by the rule, one at a time."""
    nxt, held, out = {}, [], []
    for e, batch in enumerate(epochs):
        held += [(e, p) for p in batch]
        for cap in {p[0] for _, p in held}:
            old = [p[1] for a, p in held if p[0] == cap and patience is not None and a <= e - patience]
            n = max([nxt.get(cap, 0), *[s + 1 for s in old]])
            have = {p[1] for _, p in held if p[0] == cap}
            while n in have:
                n += 1
            nxt[cap] = n
        out.append(sorted(p for _, p in held if p[1] < nxt[p[0]]))
        held = [(a, p) for a, p in held if p[1] >= nxt[p[0]]]
    return out, sorted(p for _, p in held)


def feed_all(spark, buffer, epochs):
    return [sorted(tuple(r) for r in buffer.feed(spark.createDataFrame(b, PACKET), e).collect()) for e, b in enumerate(epochs)]


def test_buffer_releases_by_the_rule(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(reorder, "BLOCK", 8)  # several blocks, full and not
    rnd = random.Random(5)
    packets = [(cap, s, f"{cap}{s}") for cap in ("a", "b") for s in range(45) if (cap, s) not in {("a", 20), ("b", 33)}]
    packets += [("a", 3, "again"), ("a", 3, "again"), ("b", 40, "again")]  # repeated numbers
    late = ("a", 20, "late")
    packets.sort(key=lambda p: p[1] + rnd.random() * 25)
    epochs = [packets[i:i + 20] for i in range(0, len(packets), 20)] + [[], [late]]
    for patience in (None, 1, 2):
        buffer = ReorderBuffer(spark, os.path.join(tmpdir_path, f"held-{patience}"), patience)
        want, rest = brute_release(epochs, patience)
        assert feed_all(spark, buffer, epochs) == want, patience
        last = len(epochs) - 1  # run again: the same rows, and nothing moves
        again = sorted(tuple(r) for r in buffer.feed(spark.createDataFrame(epochs[last], PACKET), last).collect())
        assert again == want[last]
        assert sorted(tuple(r) for r in buffer.flush().collect()) == rest
        assert sorted(p for e in [*want, rest] for p in e) == sorted(p for e in epochs for p in e)
        after = [("a", 45, "new"), ("a", 1, "very late")]  # the stream goes on after a flush
        got = sorted(tuple(r) for r in buffer.feed(spark.createDataFrame(after, PACKET), last + 1).collect())
        assert got == sorted(after)


def test_empty_buffer(spark, tmpdir_path):
    buffer = ReorderBuffer(spark, os.path.join(tmpdir_path, "held"))
    assert buffer.flush() is None
    assert buffer.feed(spark.createDataFrame([], PACKET), 0).count() == 0 and buffer.flush().count() == 0


def hosts_of(spark, rows):
    schema = ("capture_id string, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, seq long, named string, "
              "host string, port_app string, packet_bytes int, is_parsed boolean")
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[x] for x in names) for r in rows], schema)


def test_states_over_epochs_equal_sequential(spark, tmpdir_path):
    rows = random_rows(11, n=600, flows=15)
    rows[7] = dict(rows[7], is_parsed=False, named=None, host=None)
    want, _ = simulate([r for r in rows if r["is_parsed"]])
    want[rows[7]["seq"]] = (None, None, None, None)
    rows.sort(key=lambda r: r["seq"])
    states = OrderedStates(spark, os.path.join(tmpdir_path, "states"), buckets=4)
    got = {}
    for e, cut in enumerate([(0, 0), (0, 90), (90, 100), (100, 600)]):
        for _ in range(2 if e == 2 else 1):  # an epoch that runs twice counts once
            for r in states.apply(hosts_of(spark, rows[slice(*cut)]), e).collect():
                got[r.seq] = (r.app_state, r.host_state, r.flow_packets, r.flow_bytes)
    assert got == want


def test_run_in_order_equals_sequential(spark, tmpdir_path):
    rows = random_rows(12, n=400, flows=12)
    want, _ = simulate(rows)
    rnd = random.Random(1)
    late = sorted(rows, key=lambda r: r["seq"] + 150 * rnd.random())
    src = os.path.join(tmpdir_path, "src")
    schema = hosts_of(spark, rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    at = os.path.join(tmpdir_path, "state")
    for i, half in enumerate((late[:250], late[250:])):  # a restart between the two
        for j in range(2):
            hosts_of(spark, half[j::2]).coalesce(1).write.parquet(f"{src}/{i}{j}")
        out = run_in_order(stream, None, path=at, close=i == 1)
    got = {r.seq: (r.app_state, r.host_state, r.flow_packets, r.flow_bytes) for r in spark.read.parquet(out).collect()}
    assert got == want and spark.read.parquet(out).count() == 400


def test_evictions_equal_brute_force(spark, tmpdir_path):
    rows, rnd, t = random_rows(13, n=300, flows=25), random.Random(2), 0
    rows.sort(key=lambda r: r["seq"])
    for r in rows:
        t += rnd.choice([1, 1, 2, 9])
        r["ts_sec"], r["ts_usec"] = t, 250_000
    idle = 30
    live, want = {}, set()

    def close(key, m):
        port = m["rows"][0]["port_app"]
        named = [r["named"] for r in m["rows"]]
        app = (named[0] or "DNS") if port == "DNS" else next((x for x in named if x), port)
        host = next((r["host"] for r in reversed(m["rows"]) if r["host"] is not None), None)
        want.add((*key, len(m["rows"]), sum(r["packet_bytes"] for r in m["rows"]), app, host, m["rows"][0]["ts_sec"], m["last"]))

    for r in rows:
        key = tuple(r[x] for x in FLOW_KEY)
        if key in live and r["ts_sec"] - live[key]["last"] > idle:
            close(key, live.pop(key))
        m = live.setdefault(key, {"rows": []})
        m["rows"].append(r)
        m["last"] = r["ts_sec"]
    for key, m in live.items():
        if m["last"] + idle <= t:
            close(key, m)
    df = hosts_of(spark, rows).join(spark.createDataFrame(pd.DataFrame([{x: r[x] for x in ("seq", "ts_sec", "ts_usec")} for r in rows])), "seq")
    src = os.path.join(tmpdir_path, "src")
    for i in range(3):
        df.filter(f"seq >= {i * 100} and seq < {i * 100 + 100}").coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out = run_to_table(stream_flow_evictions(stream, f"{idle} seconds"), mode="append", trigger="drain")
    got = {(*[r[x] for x in FLOW_KEY], r.packet_count, r.byte_count, r.app, r.host, int(r.first), int(r.last))
           for r in spark.read.parquet(out).selectExpr("*", "unix_seconds(first_ts) first", "unix_seconds(last_ts) last").collect()}
    assert got == want and len(want) > 10

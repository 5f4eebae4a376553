"""Packets packed by flow for the stateful step of a stream."""

import random

import pyarrow as pa
import pytest

from tests.test_flow_state import NAMED, PORTS, simulate
from wirelens.schemas import FLOW_KEY
from wirelens.streaming import packed
from wirelens.streaming.state import CARRIED_SCHEMA, INPUT_COLUMNS, OUTPUT_SCHEMA, PackedFlowProcessor, classes, steps, stream_flow_state

TYPES = dict(bucket=pa.int64(), capture_id=pa.string(), src_ip=pa.int64(), dst_ip=pa.int64(), src_port=pa.int32(), dst_port=pa.int32(),
             protocol=pa.int16(), seq=pa.int64(), named=pa.string(), host=pa.string(), port_app=pa.string(), packet_bytes=pa.int32())
CARRIED = dict(bucket=pa.int64(), capture_id=pa.string(), src_ip=pa.int64(), dst_ip=pa.int64(), src_port=pa.int32(), dst_port=pa.int32(),
               protocol=pa.int16(), n=pa.int64(), unnumbered=pa.int64(), seqs=pa.binary(), sizes=pa.binary(), size=pa.int64(), port_app=pa.string(),
               named=pa.string(), named_at=pa.int64(), host_at=pa.binary(), host_lengths=pa.binary(), host_text=pa.binary(), last_host=pa.string(),
               app_before=pa.string(), app_after=pa.string(), app_at=pa.int64(), host=pa.string(), packets=pa.int64(), bytes=pa.int64())


class Kept:
    """A map state that counts how often it is asked."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value


def batches(rows, size):
    cut = [rows[k:k + size] for k in range(0, len(rows), size)]
    return [pa.RecordBatch.from_pylist(c, schema=pa.schema(list(TYPES.items()))) for c in cut]


def epoch(processor, rows, size=97):
    """What a micro-batch of ``rows`` comes to, by the three steps; rows handed to the handler."""
    from pyspark.sql import Row

    made = [b.to_pylist() for b in packed.pack(iter(batches(rows, size)))]
    shapes = Row(*packed.PACKED_SCHEMA.names)
    given, out = 0, []
    for bucket in sorted({r["bucket"] for part in made for r in part}):
        mine = [shapes(*[r[x] for x in packed.PACKED_SCHEMA.names]) for part in made for r in part if r["bucket"] == bucket]
        given += len(mine)
        out += [r.asDict() for r in processor.handleInputRows((bucket,), iter(mine), None)]
    some = pa.RecordBatch.from_pylist(out, schema=pa.schema([(x, CARRIED[x] if x != "port_app" else pa.string()) for x in CARRIED_SCHEMA.names]))
    got = [r for b in packed.unpack(iter([some.slice(0, len(out) // 2), some.slice(len(out) // 2)])) for r in b.to_pylist()]
    return got, given


def processor():
    p = PackedFlowProcessor()
    p.flows = Kept()
    return p


def random_packets(seed, n=2400, flows=50):
    rnd = random.Random(seed)
    keys = [(rnd.choice(["c", "d", None]), 1 << 31 | i, i, 1000, rnd.choice(list(PORTS)), rnd.choice([6, 17])) for i in range(flows)]
    rows = []
    for s in range(n):
        k = keys[min(int(rnd.paretovariate(1.1)) - 1, flows - 1)]
        rows.append(dict(zip(FLOW_KEY, k), bucket=hash(k) % 7, seq=s, named=rnd.choice(NAMED), port_app=PORTS[k[4]], packet_bytes=rnd.randint(0, 1500),
                         host=rnd.choice(["a.com", "bücher.example", "", "漢字.org", None, None, None])))
    return rows


@pytest.mark.parametrize("hold, rows", [(1 << 18, 1 << 16), (150, 40)])
def test_packed_steps_equal_sequential(monkeypatch, hold, rows):
    """Over three micro-batches, each out of order in itself; packed in one part and in many."""
    monkeypatch.setattr(packed, "HOLD", hold)
    monkeypatch.setattr(packed, "ROWS", rows)
    all_rows = random_packets(hold)
    expect, _ = simulate(all_rows)
    p, got, given = processor(), [], 0
    for part in (all_rows[:700], all_rows[700:750], all_rows[750:]):
        part = random.Random(1).sample(part, len(part))
        out, n = epoch(p, part)
        got += out
        given += n
    assert {r["seq"]: (r["app_state"], r["host_state"], r["flow_packets"], r["flow_bytes"]) for r in got} == expect and len(got) == len(all_rows)
    by = {r["seq"]: r for r in all_rows}
    assert all(r["packet_bytes"] == by[r["seq"]]["packet_bytes"] and all(r[k] == by[r["seq"]][k] for k in FLOW_KEY) for r in got)
    touched = [{tuple(r[k] for k in FLOW_KEY) for r in part} for part in (all_rows[:700], all_rows[700:750], all_rows[750:])]
    assert p.flows.calls == 2 * sum(map(len, touched))  # twice a flow and micro-batch, however many packets it has
    assert given == sum(map(len, touched)) if hold > len(all_rows) else given > sum(map(len, touched))


def test_packets_without_number_come_last_and_none_has_a_host():
    key = dict(zip(FLOW_KEY, ("c", 1, 2, 3, 80, 6)), bucket=3, port_app="HTTP")
    rows = [dict(key, seq=None, named="Google", host=None, packet_bytes=5), dict(key, seq=-4, named=None, host=None, packet_bytes=7),
            dict(key, seq=9, named=None, host=None, packet_bytes=1)]
    got, _ = epoch(processor(), rows)
    assert [(r["seq"], r["app_state"], r["host_state"], r["flow_packets"], r["flow_bytes"], r["packet_bytes"]) for r in got] == [
        (-4, "HTTP", None, 1, 7, 7), (9, "HTTP", None, 2, 8, 1), (None, "Google", None, 3, 13, 5)]
    assert list(packed.pack(iter([]))) == [] and list(packed.pack(iter(batches(rows, 9)[:1][0].slice(0, 0) for _ in range(2)))) == []


def test_classes_are_those_of_the_steps():
    names = [None, "YouTube", "HTTP"]
    for app in (None, "HTTP", "UNKNOWN", "DNS", "Google"):
        for port in (None, "HTTP", "DNS"):
            for seen in [(a, b, c) for a in names for b in names for c in names]:
                at = next((k for k, x in enumerate(seen) if x is not None), None)
                before, after, place = classes(app, port, None if at is None else seen[at], at)
                state = None if app is None else (app, None, 1, 1)
                want = [s[0] for s in steps([(k, x, None, 1) for k, x in enumerate(seen)], port, state)]
                assert [after if k >= place else before for k in range(3)] == want and after == want[-1]


def test_stream_steps_by_bucket_not_by_packet(spark, tmpdir_path):
    """Spark calls the handler once a bucket; flows of a second run find their state."""
    import os

    from pyspark.sql import functions as F

    from wirelens.streaming.aggregates import run_to_table

    rows = [{k: v for k, v in r.items() if k != "bucket"} | {"is_parsed": True, "batch": r["seq"] // 800} for r in random_packets(7)]
    expect, _ = simulate(rows)
    schema = "capture_id string, src_ip bigint, dst_ip bigint, src_port int, dst_port int, protocol smallint, seq bigint, named string, host string, port_app string, packet_bytes int, is_parsed boolean"
    drop = os.path.join(tmpdir_path, "drop")
    df = spark.createDataFrame([tuple(r[x.split()[0]] for x in schema.split(", ")) for r in rows], schema)
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    for k in range(3):
        df.filter(F.floor(F.col("seq") / 800) == k).coalesce(1).write.mode("append").parquet(drop)
        st = stream_flow_state(spark.readStream.schema(schema).parquet(drop))
        assert st.columns == OUTPUT_SCHEMA.names and "TransformWithState" in st._jdf.queryExecution().analyzed().toString()
        assert "bucket" in st._jdf.queryExecution().analyzed().toString()
        run_to_table(st, out, mode="append", checkpoint=ckpt)
    got = {r.seq: (r.app_state, r.host_state, r.flow_packets, r.flow_bytes) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()}
    assert got == expect and set(INPUT_COLUMNS) <= set(df.columns)

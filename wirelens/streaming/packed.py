"""Packets of a flow packed into one row, for the stateful step of a stream.

What a micro-batch does to a flow's state is told by a few values: how many
packets and bytes it has, its first class and where that stands, its last host.
``pack`` makes one row of them for each flow (of at most ``HOLD`` packets) and
carries along what its packets need of themselves in binary columns, which the
state handler passes on unread. ``unpack`` gives every packet its state from the
row and the state the flow had before. Both work on whole Arrow columns, so only
flows, not packets, cost a step of Python. Flows lie in ``BUCKETS`` buckets by a
hash: Spark calls the handler, and gets an Arrow batch of it, once a bucket.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from ..schemas import FLOW_KEY

#: Packets held by a packing task, and packets unpacked at once, about.
HOLD, ROWS = 1 << 18, 1 << 16
#: Part of a stream's state: another number finds no state of an earlier run.
BUCKETS = 1024

KEY_FIELDS = [
    T.StructField("capture_id", T.StringType(), True),
    T.StructField("src_ip", T.LongType(), True),
    T.StructField("dst_ip", T.LongType(), True),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.ShortType(), True),
]
#: A flow's packets in ascending ``seq``: how many, the last so many without a
#: number; their numbers and sizes; the flow's port class, its first class and
#: the place of the packet that has it; the hosts, with their places and lengths.
PACKED_FIELDS = [
    T.StructField("n", T.LongType(), True),
    T.StructField("unnumbered", T.LongType(), True),
    T.StructField("seqs", T.BinaryType(), True),
    T.StructField("sizes", T.BinaryType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("port_app", T.StringType(), True),
    T.StructField("named", T.StringType(), True),
    T.StructField("named_at", T.LongType(), True),
    T.StructField("host_at", T.BinaryType(), True),
    T.StructField("host_lengths", T.BinaryType(), True),
    T.StructField("host_text", T.BinaryType(), True),
    T.StructField("last_host", T.StringType(), True),
]
#: The class before and from a place on; host, packets and bytes of the state before.
CARRIED_FIELDS = [
    T.StructField("app_before", T.StringType(), True),
    T.StructField("app_after", T.StringType(), True),
    T.StructField("app_at", T.LongType(), True),
    T.StructField("host", T.StringType(), True),
    T.StructField("packets", T.LongType(), True),
    T.StructField("bytes", T.LongType(), True),
]
PACKED_SCHEMA = T.StructType([T.StructField("bucket", T.LongType(), True)] + KEY_FIELDS + PACKED_FIELDS)
CARRIED_SCHEMA = T.StructType(KEY_FIELDS + PACKED_FIELDS + CARRIED_FIELDS)


def pack(batches):
    """Packets (``INPUT_COLUMNS`` of ``state.py`` and their bucket) as rows of ``PACKED_SCHEMA``."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= HOLD:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between neighbouring bounds, as a binary array."""
    return _spans(bounds * values.itemsize, pa.py_buffer(np.ascontiguousarray(values)))


def _spans(offsets: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data or pa.py_buffer(b"")])


def packed(batches) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    order = pc.sort_indices(t, sort_keys=[(k, "ascending") for k in [*FLOW_KEY, "seq"]], null_placement="at_end")
    t = t.take(order)
    col = {x: t.column(x).combine_chunks() for x in t.column_names}
    new = np.arange(t.num_rows) == 0
    for k in FLOW_KEY:
        ids = pc.dictionary_encode(col[k], null_encoding="encode").indices.to_numpy()
        new[1:] |= ids[1:] != ids[:-1]
    start = np.flatnonzero(new)
    bounds = np.append(start, t.num_rows)
    sizes = col["packet_bytes"].cast(pa.int64()).fill_null(0).to_numpy()
    none = col["seq"].is_null().to_numpy(zero_copy_only=False)

    at = np.flatnonzero(col["named"].is_valid().to_numpy(zero_copy_only=False))
    k = np.searchsorted(at, bounds)
    has = k[1:] > k[:-1]
    first = at[np.where(has, k[:-1], 0)] if len(at) else start

    hosts = col["host"].cast(pa.string())
    host_at = np.flatnonzero(hosts.is_valid().to_numpy(zero_copy_only=False))
    of = np.searchsorted(host_at, bounds)
    hosts = hosts.drop_null()
    ends = np.frombuffer(hosts.buffers()[1], np.int32)[hosts.offset:hosts.offset + len(hosts) + 1] if len(hosts) else np.zeros(1, np.int32)
    since = np.repeat(start, np.diff(of))
    hosted = np.diff(of) > 0
    return pa.RecordBatch.from_arrays([
        *[col[x].take(pa.array(start)) for x in ("bucket", *FLOW_KEY)],
        pa.array(np.diff(bounds)), pa.array(np.add.reduceat(none.astype(np.int64), start)),
        _cut(col["seq"].fill_null(0).to_numpy(), bounds), _cut(sizes, bounds), pa.array(np.add.reduceat(sizes, start)),
        col["port_app"].take(pa.array(start)),
        col["named"].take(pa.array(first, mask=~has)), pa.array(first - start, mask=~has),
        _cut((host_at - since).astype(np.int32), of), _cut(np.diff(ends), of), _spans(ends[of], hosts.buffers()[2]),
        hosts.take(pa.array(np.maximum(of[1:] - 1, 0), mask=~hosted)),
    ], names=PACKED_SCHEMA.names)


def merged(key, rows):
    """One packed row of several of a flow. A row's first class is all that is
    known of its classes and all that is needed."""
    def packets(r):
        n, of = r.n, np.frombuffer(r.seqs, np.int64)
        ends = np.append(0, np.cumsum(np.frombuffer(r.host_lengths, np.int32)))
        text, named, hosts = bytes(r.host_text), [None] * n, [None] * n
        if r.named is not None:
            named[r.named_at] = r.named
        for k, at in enumerate(np.frombuffer(r.host_at, np.int32)):
            hosts[at] = text[ends[k]:ends[k + 1]].decode()
        return pa.RecordBatch.from_arrays([
            pa.nulls(n, pa.int64()), *[pa.array([k] * n, t) for k, t in zip(key, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16()))],
            pa.array(of, mask=np.arange(n) >= n - r.unnumbered), pa.array(named, pa.string()), pa.array(hosts, pa.string()),
            pa.array([r.port_app] * n, pa.string()), pa.array(np.frombuffer(r.sizes, np.int64))],
            names=["bucket", *FLOW_KEY, "seq", "named", "host", "port_app", "packet_bytes"])

    return SimpleNamespace(**packed([packets(r) for r in rows]).to_pylist()[0])


def unpack(batches):
    """Every packet of rows of ``CARRIED_SCHEMA`` with its flow's state."""
    for b in batches:
        ends = np.cumsum(b.column("n").to_numpy())
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
            out = _unpacked(b.slice(at, to - at))
            yield from (out.slice(k, ROWS) for k in range(0, out.num_rows, ROWS))  # one flow may have more
            at = to


def _data(column: pa.Array) -> pa.Buffer:
    """The bytes of all values of a binary array, one after the other."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return (data or pa.py_buffer(b"")).slice(ends[0], ends[-1] - ends[0])


def _unpacked(b: pa.RecordBatch) -> pa.RecordBatch:
    col = {x: b.column(x) for x in b.schema.names}
    n, rows = col["n"].to_numpy(), b.num_rows
    row, total, start = np.repeat(np.arange(rows), n), int(n.sum()), np.cumsum(n) - n
    place = np.arange(total) - start[row]
    seq = pa.array(np.frombuffer(_data(col["seqs"]), np.int64), mask=place >= (n - col["unnumbered"].to_numpy())[row])
    sizes = np.frombuffer(_data(col["sizes"]), np.int64)
    so_far = np.cumsum(sizes)
    so_far = so_far - (so_far[start] - sizes[start] - col["bytes"].to_numpy())[row]
    apps = pa.concat_arrays([col["app_before"], col["app_after"]])

    ends = np.append(0, np.cumsum(np.frombuffer(_data(col["host_lengths"]), np.int32)))
    hosts = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), _data(col["host_text"])])
    of = np.repeat(start, pc.binary_length(col["host_at"]).to_numpy() // 4) + np.frombuffer(_data(col["host_at"]), np.int32)
    # a packet's host is that of the last place that has one, the state's before the first
    pick, last = np.zeros(total, np.int64), np.zeros(total, np.int64)
    pick[start], last[start] = np.arange(rows), start
    pick[of], last[of] = rows + np.arange(len(of)), of
    last = np.maximum.accumulate(last)
    return pa.RecordBatch.from_arrays([
        *[col[x].take(pa.array(row)) for x in FLOW_KEY], seq,
        apps.take(pa.array(np.where(place < col["app_at"].to_numpy()[row], row, rows + row))),
        pa.concat_arrays([col["host"].cast(pa.string()), hosts]).take(pa.array(pick[last])),
        pa.array(place + 1 + col["packets"].to_numpy()[row]), pa.array(so_far), pa.array(sizes)],
        names=[*FLOW_KEY, "seq", "app_state", "host_state", "flow_packets", "flow_bytes", "packet_bytes"])

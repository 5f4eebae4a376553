"""Stateful per-flow verdicts on a stream (T2) with optional state TTL (T5).

The state of a flow (class, last host, packet and byte counts) lives in the
streaming state store (RocksDB), keyed by a bucket and the flow key, and is updated by
``transformWithState``. The packets of a flow in one micro-batch are packed into
one row (``packed.py``); the handler reads and writes the flow's state once, by
that row, and the packets get theirs when they are unpacked, with the stored
state as carry-in. Packets of a flow must reach the stream in
``seq`` order across micro-batches (files dropped in time order); within a
batch any order is fine.

Unparsed packets pass by the state and come out with it null, as in batch.
Rules are applied after the stateful step to each micro-batch, written once,
by the batch operator (``verdict_batch``), so a rule table of any size and
kind serves a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.rules import KnownHosts, apply_rules
from ..schemas import FLOW_KEY
from .packed import BUCKETS, CARRIED_SCHEMA, KEY_FIELDS, PACKED_FIELDS, PACKED_SCHEMA, merged, pack, unpack

OVERWRITABLE = ("UNKNOWN", "HTTP", "HTTPS")

STATE_SCHEMA = T.StructType([
    T.StructField("app", T.StringType(), True),
    T.StructField("host", T.StringType(), True),
    T.StructField("packets", T.LongType(), True),
    T.StructField("bytes", T.LongType(), True),
])

OUTPUT_SCHEMA = T.StructType([
    *KEY_FIELDS,
    T.StructField("seq", T.LongType(), True),
    T.StructField("app_state", T.StringType(), True),
    T.StructField("host_state", T.StringType(), True),
    T.StructField("flow_packets", T.LongType(), True),
    T.StructField("flow_bytes", T.LongType(), True),
    T.StructField("packet_bytes", T.LongType(), True),
])

OUTPUT_ROW, CARRIED_ROW = Row(*OUTPUT_SCHEMA.names), Row(*CARRIED_SCHEMA.names)
INPUT_COLUMNS = [*FLOW_KEY, "seq", "named", "host", "port_app", "packet_bytes"]


def steps(rows, port_app, state):
    """One flow's rows ``(seq, named, host, packet_bytes)`` in ascending
    ``seq`` + stored state -> (app_state, host_state, flow_packets, flow_bytes)
    of each; the last one is the state that is stored. ``state`` is such a
    tuple or None for a new flow."""
    app, host, n, size = state if state is not None else (None, None, 0, 0)
    open_ = app is None or app in OVERWRITABLE
    for _seq, named, own, packet_bytes in rows:
        if open_:
            if named is not None:
                app, open_ = named, False
            else:
                app, open_ = port_app, port_app is None or port_app in OVERWRITABLE
        host = host if own is None else own
        n += 1
        size += packet_bytes
        yield app, host, n, size


def advance(pdf, state):
    """``steps`` of a flow's rows (sorted by seq) as a table, and the state
    after the last row."""
    import pandas as pd

    text = [[x if isinstance(x, str) else None for x in pdf[c]] for c in ("named", "host")]
    rows = zip(pdf["seq"].tolist(), *text, pdf["packet_bytes"].tolist())
    out = list(steps(rows, pdf["port_app"].iloc[0], state))
    columns = zip(["app_state", "host_state", "flow_packets", "flow_bytes"], zip(*out))
    return pd.DataFrame({k: pd.Series(v, dtype="int64" if k.startswith("flow") else object) for k, v in columns}), out[-1]


def known(st):
    """A stored state as ``steps`` takes it, None for a new flow."""
    return None if st is None else (st[0], st[1], int(st[2] or 0), int(st[3] or 0))


class FlowStateProcessor(StatefulProcessor):
    """Per-flow state machine of the reference, packet by packet: the plain
    form of ``PackedFlowProcessor``."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.state = handle.getValueState("flow", STATE_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        port_app, mine = None, []
        for r in rows:
            port_app = r.port_app  # one for all rows of a flow
            mine.append((r.seq, r.named, r.host, r.packet_bytes))
        mine.sort(key=lambda r: (r[0] is None, r[0]))
        for (seq, _named, _host, packet_bytes), now in zip(mine, steps(mine, port_app, known(self.state.get()))):
            yield OUTPUT_ROW(*key, seq, *now, packet_bytes)
        self.state.update(now)

    def close(self):
        pass


def classes(app, port_app, named, named_at):
    """(class before, class from a place on, that place) of a flow's packets by
    its stored class (None: a new flow) and the first class among them."""
    if app is not None and app not in OVERWRITABLE:
        return app, app, 0
    if named is None or named_at and port_app is not None and port_app not in OVERWRITABLE:
        return port_app, port_app, 0
    return port_app, named, named_at


class PackedFlowProcessor(StatefulProcessor):
    """Per-flow state machine of the reference, on a bucket's packed rows: a
    flow's one row of a micro-batch (several, if a task packed its packets in
    parts) goes out with the state its packets begin with. A flow's state is
    read and written once; it expires by itself."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.flows = handle.getMapState("flows", T.StructType(KEY_FIELDS), STATE_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        found: dict = {}
        for r in rows:
            found.setdefault(tuple(r[1:1 + len(KEY_FIELDS)]), []).append(r)
        for flow, parts in found.items():
            r = parts[0] if len(parts) == 1 else merged(flow, parts)
            app, host, n, size = known(self.flows.getValue(flow)) or (None, None, 0, 0)
            now = classes(app, r.port_app, r.named, r.named_at)
            yield CARRIED_ROW(*flow, *[getattr(r, f.name) for f in PACKED_FIELDS], *now, host, n, size)
            self.flows.updateValue(flow, (now[1], host if r.last_host is None else r.last_host, n + r.n, size + r.size))

    def close(self):
        pass


def stream_flow_state(hosts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming ``app_state`` / ``host_state`` / counters for parsed packets."""
    src = hosts.filter(F.col("is_parsed")).select(F.pmod(F.xxhash64(*FLOW_KEY), F.lit(BUCKETS)).alias("bucket"), *INPUT_COLUMNS)
    return src.repartition("bucket").mapInArrow(pack, PACKED_SCHEMA).groupBy("bucket").transformWithState(
        statefulProcessor=PackedFlowProcessor(ttl_ms),
        outputStructType=CARRIED_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    ).mapInArrow(unpack, OUTPUT_SCHEMA)


def stream_states(hosts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Every packet of a stream with its flow's state (T2, T5): parsed ones
    from the state store, the others with null state.

    ``ttl_ms`` expires the state of flows idle for that long (processing
    time); off by default so results equal the batch path.
    """
    st = stream_flow_state(hosts, ttl_ms).withColumn("is_parsed", F.lit(True))
    none = hosts.filter(~F.col("is_parsed")).select(
        *[F.col(f.name).cast(f.dataType) if f.name in ("capture_id", "seq", "packet_bytes") else F.lit(None).cast(f.dataType).alias(f.name)
          for f in OUTPUT_SCHEMA.fields], F.lit(False).alias("is_parsed"))
    return st.union(none)


def verdict_batch(rules: DataFrame | None, ip_match: str = "low_endpoint"):
    """The function that gives the packets of a micro-batch of
    ``stream_states`` their verdicts, for ``run_to_table(per_batch=...)``. It
    serves one stream: what a micro-batch found out about a host holds for the
    later ones."""
    known = KnownHosts(rules) if rules is not None else None

    def judge(batch: DataFrame) -> DataFrame:
        v = apply_rules(batch, rules, ip_match=ip_match, known=known)
        hit = F.coalesce(F.col("blocked") & F.col("is_parsed"), F.lit(False))
        return v.withColumns({"blocked": hit, "block_reason": F.when(hit, F.col("block_reason"))})
    return judge

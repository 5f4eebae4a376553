"""Per-flow state (W1, W2, W4), the flow table (A4) and flow lookup.

The reference keeps a mutable flow record per 5-tuple and updates it packet
by packet. Because the port class is constant within a flow (the
normalised destination port is part of the key), that state machine has a
closed form:

  app_state  = DNS flows:   named class of the flow's first packet, else DNS
               other flows: first non-NULL named class so far, else port class
  host_state = last non-NULL host so far ('' counts as a host)

Packet mode needs these as running values per packet: prefix scans over the
flow in ``seq`` order. They are computed over ranges of (flow, seq):

1. a thinned sample of the packets' keys (``split_flows``) finds the flows
   with more than ``piece_rows`` packets and cuts them at sampled ``seq``
   borders into pieces of about that size; every other flow is one piece, so
   no window partition grows with a hot flow;
2. packets move once, by (flow, piece), and a window gives each its running
   values within the piece;
3. only flows that were cut have a carry: the first packet's class, the first
   class, the last host and the counts of a piece are combined over the pieces
   before it (all associative) and added by an equi-join on the key the packets
   are partitioned and sorted by already. A capture without such a flow has
   neither carry nor join.

Nothing is checkpointed here: one exchange of pruned rows.

Flow mode and the flow table need only the final state, which is a plain
hash aggregate (``min_by`` / ``max_by`` with FILTER) - no sort, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FLOW_KEY

# Packets of a window partition, about: flows with more are cut into pieces.
DEFAULT_PIECE_ROWS = 1 << 20
# Sampled packets that stand for one piece; the rest are thinned out.
PIECE_SAMPLES = 1 << 10

_UNB = Window.unboundedPreceding


def flow_app(port_class: Column, first_named: Column, first_nonnull_named: Column) -> Column:
    """The class of a flow by its port class, its first packet's class and its first class."""
    return (F.when(port_class == "DNS", F.coalesce(first_named, F.lit("DNS")))
            .otherwise(F.coalesce(first_nonnull_named, port_class)))


def split_flows(df: DataFrame, piece_rows: int = DEFAULT_PIECE_ROWS) -> DataFrame | None:
    """``(__flow, borders)``, the flow by its hash, of the flows that are cut: the ascending
    ``seq`` at which each piece but the first begins. None if there are none.

    Packets are thinned by a hash of (capture, seq) to ``PIECE_SAMPLES`` a
    piece before anything else is computed of them. A flow is cut at every
    ``PIECE_SAMPLES``-th of its samples, so all borders together are at most
    the packets divided by ``piece_rows``: a table that grows with the number
    of pieces, not of flows, and is small enough to broadcast.
    """
    from ..session import scratch_table

    per_piece = min(piece_rows, PIECE_SAMPLES)
    rate = max(1, piece_rows // per_piece)
    thin = F.pmod(F.xxhash64("capture_id", "seq"), F.lit(rate)) == 0
    sample = df.filter(F.col("is_parsed") & thin).select(_flow_hash().alias("__flow"), "seq")
    hot = sample.groupBy("__flow").count().filter(F.col("count") > per_piece).select("__flow")
    hot = scratch_table(hot, "hot-flows")
    if hot.isEmpty():
        return None
    w = Window.partitionBy("__flow").orderBy("seq")
    borders = (sample.join(hot, "__flow").withColumn("__n", F.row_number().over(w) - 1)
               .filter((F.col("__n") > 0) & (F.col("__n") % per_piece == 0))
               .groupBy("__flow").agg(F.sort_array(F.collect_list("seq")).alias("borders")))
    return scratch_table(borders, "flow-borders")


def _flow_hash() -> Column:
    """64 bits of the flow key. Flows of one hash are cut alike, which changes
    no result: any borders within a flow do. With the fields as keys of a join
    the optimizer would test each for null first, and decode for each test."""
    return F.xxhash64(*FLOW_KEY)


def _piece(seq: Column, borders: Column) -> Column:
    """Number of borders up to ``seq``, by binary search in steps of powers
    of two (an array of any length has less than 2**31 elements)."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda s: s <= F.size(borders))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(borders, at + s - 1) <= seq, at + s).otherwise(at))


def with_flow_state(df: DataFrame, piece_rows: int = DEFAULT_PIECE_ROWS,
                    partitions: int | None = None) -> DataFrame:
    """Adds ``app_state``, ``host_state``, ``flow_packets``, ``flow_bytes``.

    Input: decoded, inspected and classified packets (``is_parsed``, flow
    key, ``seq``, ``named``, ``host``, ``port_app``, ``packet_bytes``). Every
    other column is carried through. Unparsed rows get NULL state and are
    spread over the shuffle by their own ``seq`` (they never share state).

    Needs one pass over the keys of a thinned sample first. ``partitions``
    sets the size of the exchange; by default it is Spark's
    (``spark.sql.shuffle.partitions``, joined by AQE where small).
    """
    c = F.col
    key = [*FLOW_KEY, "__piece"]
    own = list(df.columns)
    cut_flows = split_flows(df, piece_rows)
    if cut_flows is None:
        piece = F.lit(0).cast("bigint")
    else:
        # at most one border for each ``piece_rows`` packets
        df = df.withColumn("__flow", _flow_hash()).join(F.broadcast(cut_flows), "__flow", "left")
        piece = F.when(c("borders").isNull(), F.lit(0)).otherwise(_piece(c("seq"), c("borders"))).cast("bigint")
    pieces = df.withColumn("__piece", F.when(c("is_parsed"), piece).otherwise(-1 - c("seq")))
    df = pieces.select(*own, "__piece")
    if partitions:
        df = df.repartition(partitions, *key)
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(_UNB, Window.currentRow)
    local = df.select(
        "*",
        F.first("named").over(w).alias("__first"),
        F.first("named", ignorenulls=True).over(w).alias("__fnn"),
        F.last("host", ignorenulls=True).over(w).alias("__lh"),
        F.count(F.lit(1)).over(w).alias("__cnt"),
        F.sum("packet_bytes").over(w).alias("__bytes"),
    )
    first, fnn, host, cnt, byts = (c(x) for x in ("__first", "__fnn", "__lh", "__cnt", "__bytes"))
    if cut_flows is not None:
        local = local.join(_carry(pieces), key, "left")
        later = c("__c_cnt").isNotNull()
        first = F.when(later, c("__c_first")).otherwise(first)
        fnn, host = F.coalesce("__c_fnn", "__fnn"), F.coalesce("__lh", "__c_lh")
        cnt, byts = (F.coalesce(c(f"__c_{x}"), F.lit(0)) + c(f"__{x}") for x in ("cnt", "bytes"))
    p = c("is_parsed")
    return local.select(
        *own,
        F.when(p, flow_app(c("port_app"), first, fnn)).alias("app_state"),
        F.when(p, host).alias("host_state"),
        F.when(p, cnt).cast("bigint").alias("flow_packets"),
        F.when(p, byts).cast("bigint").alias("flow_bytes"),
    )


def _carry(pieces: DataFrame) -> DataFrame:
    """What the pieces before each piece of a cut flow leave to it: one row
    for every piece but a flow's first."""
    key = [*FLOW_KEY, "__piece"]
    # one row per piece; the partial aggregates make few rows of many packets
    summary = pieces.filter(F.col("borders").isNotNull() & F.col("is_parsed")).groupBy(*key).agg(
        F.min_by("named", "seq").alias("__first"),
        F.expr("min_by(named, seq) FILTER (WHERE named IS NOT NULL)").alias("__fnn"),
        F.expr("max_by(host, seq) FILTER (WHERE host IS NOT NULL)").alias("__lh"),
        F.count(F.lit(1)).alias("__cnt"),
        F.sum("packet_bytes").alias("__bytes"),
    )
    before = Window.partitionBy(*FLOW_KEY).orderBy("__piece").rowsBetween(_UNB, -1)
    return summary.select(
        *key,
        F.first("__first").over(before).alias("__c_first"),
        F.first("__fnn", ignorenulls=True).over(before).alias("__c_fnn"),
        F.last("__lh", ignorenulls=True).over(before).alias("__c_lh"),
        F.sum("__cnt").over(before).alias("__c_cnt"),
        F.sum("__bytes").over(before).alias("__c_bytes"),
    ).filter(F.col("__c_cnt").isNotNull())


def with_flow_state_window(df: DataFrame) -> DataFrame:
    """Single-level window form of ``with_flow_state`` (reference for tests;
    one window partition per flow, so not skew-safe)."""
    c = F.col
    w = Window.partitionBy(*FLOW_KEY).orderBy("seq").rowsBetween(_UNB, Window.currentRow)
    p = c("is_parsed")
    return df.select(
        "*",
        F.when(p, flow_app(c("port_app"), F.first("named").over(w),
                             F.first("named", ignorenulls=True).over(w))).alias("app_state"),
        F.when(p, F.last("host", ignorenulls=True).over(w)).alias("host_state"),
        F.when(p, F.count(F.lit(1)).over(w)).cast("bigint").alias("flow_packets"),
        F.when(p, F.sum("packet_bytes").over(w)).cast("bigint").alias("flow_bytes"),
    )


def flow_table(df: DataFrame) -> DataFrame:
    """Final state per flow (A4), one hash aggregate over parsed packets.

    Columns: flow key, ``packet_count``, ``byte_count``, ``app`` (final
    class), ``host`` (last host, NULL if none), ``blocked`` (any packet
    blocked; only when the input has verdicts).
    """
    c = F.col
    aggs = [
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("packet_bytes").cast("bigint").alias("byte_count"),
        F.min_by("named", "seq").alias("__first"),
        F.expr("min_by(named, seq) FILTER (WHERE named IS NOT NULL)").alias("__fnn"),
        F.expr("max_by(host, seq) FILTER (WHERE host IS NOT NULL)").alias("host"),
        F.any_value("port_app").alias("__port_app"),
    ]
    if "blocked" in df.columns:
        aggs.append(F.bool_or(F.coalesce(c("blocked"), F.lit(False))).alias("blocked"))
    g = df.filter(c("is_parsed")).groupBy(*FLOW_KEY).agg(*aggs)
    cols = [*FLOW_KEY, "packet_count", "byte_count",
            flow_app(c("__port_app"), c("__first"), c("__fnn")).alias("app"), "host"]
    if "blocked" in df.columns:
        cols.append("blocked")
    return g.select(*cols)


def packets_with_flow(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Each parsed packet with its flow's final record (J5), by an equi-join
    on the flow key. The flow side has one row per key, so AQE can split a
    hot flow's packets across tasks (skew join) without duplicating work."""
    f = flows.select(*FLOW_KEY, *[F.col(x).alias(f"flow_{x}") for x in flows.columns
                                  if x not in FLOW_KEY])
    return packets.filter(F.col("is_parsed")).join(f, FLOW_KEY, "inner")

"""Packets that reach a stream out of order over micro-batches.

``ReorderBuffer`` holds the packets of a capture until all before them are
there, ``OrderedStates`` gives what is released its flow state, and
``run_in_order`` runs a stream through both and through the block rules. Every
step is a batch job of a micro-batch on tables in the shared folder, so no flow
is ever held whole by one Python worker, and a hot flow is cut as in batch.

Both keep what they know in an ``EpochLog``: a micro-batch that is run again
finds its manifest and gives the same rows once more without counting them
twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.flows import with_flow_state
from ..schemas import FLOW_KEY
from ..session import scratch_path, scratch_table
from .aggregates import EpochLog, KeyedTable, run_to_table
from .state import verdict_batch

# Sequence numbers of a block: blocks are counted whole, only the first that
# is not full is looked at packet by packet.
BLOCK = 1 << 16


class ReorderBuffer(EpochLog):
    """Releases the packets of each capture in the order of ``seq``.

    A packet is released once every number from ``first_seq`` up to its own
    has arrived, or once a packet of its number or a later one has been held
    for ``patience`` epochs (None: however long), so a packet lost on the way
    stops nothing for longer. ``flush`` releases what is left at the end.
    A packet that comes after its place was given up is released at once:
    nothing is dropped, and repeated numbers are all kept.
    """

    def __init__(self, spark: SparkSession, path: str, patience: int | None = None, first_seq: int = 0):
        super().__init__(spark, path)
        self.patience, self.first_seq = patience, first_seq

    def feed(self, batch: DataFrame, epoch: int) -> DataFrame:
        """The packets that epoch ``epoch``, which brings ``batch``, releases."""
        return self._advance(batch, 2 * epoch)

    def flush(self) -> DataFrame | None:
        """All packets still held; None before the first epoch."""
        done = self.epochs()
        if not done:
            return None
        return self._advance(None, done[-1] | 1)  # between the epochs of the stream

    def _advance(self, batch: DataFrame | None, at: int) -> DataFrame:
        out = f"{self.path}/epoch-{at}"
        if at not in self.epochs():
            done = [e for e in self.epochs() if e < at]
            before = self.manifest(done[-1]) if done else None
            pending, known = [], None
            if batch is not None:
                pending.append(batch.withColumn("__arrived", F.lit(at).cast("bigint")))
            if before:
                pending.append(self._rows(before, f"{self.path}/epoch-{done[-1]}", released=False))
                known = self.spark.read.schema("capture_id string, next_seq bigint").parquet(before["progress"])
            rows = pending[0] if len(pending) == 1 else pending[0].unionByName(pending[1])
            progress = f"{self.path}/progress-{at}"
            self._frontier(rows, known, at, everything=batch is None).write.mode("overwrite").parquet(progress)
            reached = self.spark.read.schema("capture_id string, next_seq bigint").parquet(progress)
            (rows.join(reached, "capture_id").withColumn("__released", F.col("seq") < F.col("next_seq")).drop("next_seq")
             .write.mode("overwrite").partitionBy("__released").parquet(out))
            self.publish(at, {"schema": self.columns_of(rows), "progress": progress})
            for e in done[:-1]:  # a stream runs no epoch again but the last
                self.forget(f"epoch-{e}")
                self.forget(f"progress-{e}")
        return self._rows(self.manifest(at), out, released=True).drop("__arrived")

    def _rows(self, manifest: dict, path: str, released: bool) -> DataFrame:
        return (self.spark.read.schema(manifest["schema"] + ", __released boolean").parquet(path)
                .filter(F.col("__released") == released).drop("__released"))

    def _frontier(self, rows: DataFrame, known: DataFrame | None, at: int, everything: bool) -> DataFrame:
        """``(capture_id, next_seq)``: the first number of each capture that is not released."""
        c = F.col
        aged = F.lit(everything)
        if self.patience is not None:
            aged = aged | (c("__arrived") <= at - 2 * self.patience)
        start = rows.groupBy("capture_id").agg((F.max(F.when(aged, c("seq"))) + 1).alias("next_seq"))
        if known is not None:
            start = start.unionByName(known)
        start = scratch_table(start.groupBy("capture_id").agg(
            F.greatest(F.max("next_seq"), F.lit(self.first_seq)).cast("bigint").alias("next")), "reorder-start")
        seqs = rows.select("capture_id", "seq").distinct().join(start, "capture_id").filter(c("seq") >= c("next"))

        def block(x: Column) -> Column:
            return F.floor(x / BLOCK).cast("bigint")

        counted = seqs.groupBy("capture_id", "next", block(c("seq")).alias("block")).count()
        n = F.row_number().over(Window.partitionBy("capture_id").orderBy("block")) - 1
        room = F.least(F.lit(BLOCK), (c("block") + 1) * BLOCK - c("next"))
        full = (c("block") == block(c("next")) + c("n")) & (c("count") == room)
        heads = counted.withColumn("n", n).groupBy("capture_id", "next").agg(
            F.coalesce(F.min(F.when(~full, c("n"))), F.count(F.lit(1))).alias("whole"))
        heads = heads.select("capture_id", (block(c("next")) + c("whole")).alias("block"),
                             F.greatest(c("next"), (block(c("next")) + c("whole")) * BLOCK).alias("from"))
        place = F.row_number().over(Window.partitionBy("capture_id").orderBy("seq")) - 1  # at most BLOCK rows each
        run = (seqs.withColumn("block", block(c("seq"))).join(heads, ["capture_id", "block"])
               .withColumn("place", place).filter(c("seq") == c("from") + c("place")).groupBy("capture_id").agg(F.count(F.lit(1)).alias("run")))
        moved = heads.join(run, "capture_id", "left").select("capture_id", (c("from") + F.coalesce("run", F.lit(0))).alias("to"))
        return start.join(moved, "capture_id", "left").select(
            "capture_id", F.coalesce("to", "next").cast("bigint").alias("next_seq"))


def merge_states(rows: DataFrame) -> DataFrame:
    """Last state of each flow, of packets with their states or of earlier
    records. Within a flow ``flow_packets`` tells what came last."""
    c = F.col
    packet = "decided" not in rows.columns
    if packet:
        rows = rows.filter("is_parsed").withColumn("decided", c("named").isNotNull() | (c("port_app") == "DNS"))
    return rows.groupBy(*FLOW_KEY).agg(
        F.max_by("app_state", "flow_packets").alias("app_state"), F.max_by("host_state", "flow_packets").alias("host_state"),
        F.bool_or("decided").alias("decided"), F.max("flow_bytes").alias("flow_bytes"), F.max("flow_packets").alias("flow_packets"))


class OrderedStates:
    """Flow states of packets that arrive in order, by the batch operator:
    what a micro-batch's packets make of themselves, joined with what the
    flow's earlier micro-batches left."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, FLOW_KEY, merge_states, buckets)

    def apply(self, rows: DataFrame, epoch: int) -> DataFrame:
        """``rows`` with ``app_state``, ``host_state``, ``flow_packets`` and ``flow_bytes``."""
        c = F.col
        own = list(rows.columns)
        st = with_flow_state(rows)
        before = self.table.read(before=epoch)
        if before is not None:
            left = before.select(*FLOW_KEY, *[c(x).alias(f"__{x}") for x in before.columns if x not in FLOW_KEY])
            st = st.join(left, FLOW_KEY, "left").select(
                *own, F.when(c("is_parsed") & c("__decided"), c("__app_state")).otherwise(c("app_state")).alias("app_state"),
                F.when(c("is_parsed"), F.coalesce("host_state", "__host_state")).alias("host_state"),
                *[(c(x) + F.coalesce(c(f"__{x}"), F.lit(0))).alias(x) for x in ("flow_packets", "flow_bytes")])
        st = scratch_table(st, "ordered-states")
        self.table.upsert(st, epoch)
        return st


def run_in_order(hosts: DataFrame, rules: DataFrame | None = None, patience: int | None = None,
                 path: str | None = None, close: bool = True, ip_match: str = "low_endpoint") -> str:
    """Verdicts of a stream of inspected packets whose order over micro-batches
    is not that of ``seq``, as if they had come in order. Returns the folder of
    the result. With ``close`` the captures end with the input: what is still
    held comes out. ``path`` keeps the state for a later run."""
    spark = hosts.sparkSession
    path = path or scratch_path(spark, "in-order")
    buffer = ReorderBuffer(spark, f"{path}/held", patience)
    states = OrderedStates(spark, f"{path}/states")
    judge = verdict_batch(rules, ip_match)
    out = f"{path}/verdicts"

    def put(rows: DataFrame, at: int) -> None:
        judge(states.apply(rows, at)).write.mode("overwrite").parquet(f"{out}/batch={at}")

    run_to_table(hosts, mode="append", checkpoint=f"{path}/checkpoint", per_batch=lambda batch: batch,
                 into=lambda batch, epoch: put(buffer.feed(batch, epoch), 2 * epoch))
    if close:
        rest = buffer.flush()
        if rest is not None:
            put(rest, buffer.epochs()[-1])
    return out

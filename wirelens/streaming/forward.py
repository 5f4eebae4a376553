"""Forwarded and dropped packets of a stream as capture files.

``CaptureLog`` is a sink of capture files that become visible epoch by epoch,
``forward_stream`` runs raw packets through the reorder buffer, the flow state
and the rules into two of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.verdicts import packet_hosts, split_packets
from ..session import scratch_path, scratch_table
from ..sources.pcap import read_pcap, register, write_pcap
from .aggregates import EpochLog, run_to_table
from .reorder import OrderedStates, ReorderBuffer
from .state import verdict_batch


class CaptureLog(EpochLog):
    """Capture files of a stream. Each epoch has a folder of its own, written
    by the capture sink; its manifest, written when all its files stand, names
    it. Readers go by the manifests: what an epoch that died has left is never
    seen and is overwritten when the epoch runs again; an epoch that runs again
    behind its manifest writes nothing. An epoch without packets has no files.
    """

    def put(self, raw: DataFrame, epoch: int) -> None:
        if epoch in self.epochs():
            return
        out = f"{self.path}/epoch-{epoch}"
        some = not raw.isEmpty()
        if some:
            write_pcap(raw, out, mode="overwrite")
        self.publish(epoch, {"folder": out if some else None})

    def folders(self) -> list[tuple[int, str]]:
        """``(epoch, folder)`` of the captures of the published epochs, in order."""
        found = [(e, self.manifest(e)["folder"]) for e in self.epochs()]
        return [(e, f) for e, f in found if f]

    def read(self) -> DataFrame | None:
        """The packets of all published epochs, ``epoch`` first; a capture's
        order is (epoch, seq). None if there are none yet."""
        parts = [read_pcap(self.spark, f).select(F.lit(e).cast("bigint").alias("epoch"), "*") for e, f in self.folders()]
        return reduce(DataFrame.unionByName, parts) if parts else None


def forward_stream(raw: DataFrame, rules: DataFrame | None = None, path: str | None = None, patience: int | None = None,
                   close: bool = True, ip_match: str = "low_endpoint") -> tuple[CaptureLog, CaptureLog]:
    """``(forwarded, dropped)``: the captures that a stream of raw packets, in
    any order over micro-batches, leaves behind. The frame bytes are held with
    the packets and meet the verdicts in one join; flow state and rules see
    the decoded columns only. ``path``, ``patience`` and ``close`` as for
    ``run_in_order``."""
    spark = raw.sparkSession
    register(spark)  # micro-batches run in a copy of the session, made when the query starts
    path = path or scratch_path(spark, "forward")
    buffer = ReorderBuffer(spark, f"{path}/held", patience)
    states = OrderedStates(spark, f"{path}/states")
    logs = CaptureLog(spark, f"{path}/forwarded"), CaptureLog(spark, f"{path}/dropped")
    judge = verdict_batch(rules, ip_match)

    def put(rows: DataFrame, at: int) -> None:
        v = judge(states.apply(packet_hosts(rows), at)).filter("blocked").select("capture_id", "seq", "blocked")
        # read by both logs, each of which looks, samples for its ranges and writes: judged once
        for log, part in zip(logs, split_packets(rows, scratch_table(v, "blocked"))):
            log.put(part, at)

    run_to_table(raw, mode="append", checkpoint=f"{path}/checkpoint", per_batch=lambda batch: batch,
                 into=lambda batch, epoch: put(buffer.feed(batch, epoch), 2 * epoch))
    if close:
        rest = buffer.flush()
        if rest is not None:
            put(rest, buffer.epochs()[-1])
    return logs

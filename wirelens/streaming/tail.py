"""Captures that grow while they are read.

A capture program appends to its file for hours; a stream of whole files would
wait for its end. ``CaptureTail`` takes what has been appended since the last
epoch, up to the last complete record, and lands it as ``raw_packets`` Parquet
files, a folder an epoch, which a file stream reads on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RAW_PACKETS
from ..session import scratch_table
from ..sources.pcap import GLOBAL_HEADER, RECORD_HEADER, CaptureError
from ..sources.ranges import CHAINS, CHUNKS, RANGE_BYTES, _chains, _records, captures_below, chain_from, tasks_of
from .aggregates import EpochLog

POSITIONS = "path string, pos long, seq long, seen long, tried long"
PLAN = f"{CHUNKS}, last boolean"


def _advanced(range_bytes: int):
    """The chunks of one file's new bytes, joined end to end from the known
    position on, and a last row with the next position and ``seq`` (in entry
    and first_seq; start holds the length that needn't be looked at again)."""
    def run(admitted, chains):
        import pandas as pd

        columns = [x.split()[0] for x in PLAN.split(", ")]
        if admitted.empty:
            return pd.DataFrame(columns=columns)
        a = admitted.iloc[0]
        by = {r.start: r for r in chains.itertuples(index=False)}
        out, pos, seq = [], int(a.pos), int(a.seq)
        for start in range(pos, int(a.end), range_bytes):
            end = min(start + range_bytes, int(a.end))
            if not start <= pos < end or pos + RECORD_HEADER > a.length:
                continue  # a record spans the range, or the last complete one lies before it
            found = chain_from(by[start], pos) if start in by else None
            if found is None:
                raise CaptureError(f"{a.path}: no record begins at byte {pos}")
            if found[1]:
                out.append((a.path, a.capture_id, seq, int(a.length), start, end, pos, seq, False))
            pos = found[0]
            seq += found[1]
        seen = int(a.length) if pos == a.pos else max(pos, int(a.end))
        out.append((a.path, a.capture_id, seq, int(a.length), seen, int(a.end), pos, seq, True))
        return pd.DataFrame(out, columns=columns)
    return run


class CaptureTail(EpochLog):
    """A log of what has been read of every capture file below ``captures``.

    ``advance`` makes an epoch of at most ``max_bytes`` new bytes (and the rest
    of the records that begin in them), files that waited longest first, so
    neither the first epoch nor one after a long pause is larger. An epoch's
    plan (byte ranges with their first ``seq``) and the position of every file
    are written first and published by a manifest, its packets then land under
    a folder of their own by one rename. An epoch that a crash cut off is
    landed from its plan by the next ``advance``: nothing is lost or repeated
    over restarts, as long as one process at a time advances a log.

    New bytes are read by ranges like any capture, a task a range, so one file
    that grows fast is shared by many tasks. Files must grow at their end
    alone; one that is shorter than what was read of it fails the epoch, as
    does a damaged record. A file without a whole header waits. Driver and
    windows see one row per file.
    """

    def __init__(self, spark: SparkSession, captures: str, path: str, pathGlobFilter: str = "*.pcap",
                 max_bytes: int = 16 << 30, range_bytes: int = RANGE_BYTES):
        super().__init__(spark, path)
        self.captures, self.glob = captures, pathGlobFilter
        self.max_bytes, self.range_bytes = max_bytes, range_bytes

    def positions(self) -> DataFrame:
        """One row per file: pos and seq of the next record, seen: the length
        that was looked at, tried: the last epoch that did."""
        done = self.epochs()
        if not done:
            return self.spark.createDataFrame([], POSITIONS)
        return self.spark.read.schema(POSITIONS).parquet(f"{self.path}/positions/epoch-{done[-1]}")

    def _admitted(self, positions: DataFrame) -> DataFrame:
        c = F.col
        begin = F.lit(GLOBAL_HEADER).cast("long")
        files = captures_below(self.spark, self.captures, self.glob).join(positions, "path", "left").select(
            "path", "capture_id", "length", F.coalesce("pos", begin).alias("pos"), F.coalesce("seq", "base").alias("seq"),
            F.coalesce("seen", begin).alias("seen"), F.coalesce("tried", F.lit(-1).cast("long")).alias("tried"))
        short = F.raise_error(F.concat(c("path"), F.lit(" is shorter than what was read of it")))
        files = files.withColumn("length", F.when(c("tried") < 0, c("length")).when(c("length") < c("pos"), short.cast("long")).otherwise(c("length")))
        # one row per file
        waited = Window.orderBy("tried", "path").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(c("length") - c("pos")).over(waited), F.lit(0))
        return (files.filter(c("length") > c("seen")).withColumn("before", before).filter(c("before") < self.max_bytes)
                .withColumn("end", F.least(c("length"), c("pos") + self.max_bytes - c("before"))).drop("before"))

    def _plan(self, admitted: DataFrame) -> DataFrame:
        starts = F.sequence("pos", F.col("end") - 1, F.lit(self.range_bytes).cast("long"))
        ranges = (admitted.select("path", "capture_id", F.col("seq").alias("base"), "length", F.explode(starts).alias("start"), F.col("end").alias("__end"))
                  .select("path", "capture_id", "base", "length", "start",
                          F.least("__end", F.col("start") + self.range_bytes).alias("end")))
        chains = ranges.repartition(tasks_of(ranges)).mapInPandas(_chains(False, growing=True), CHAINS)
        return admitted.groupBy("path").cogroup(chains.groupBy("path")).applyInPandas(_advanced(self.range_bytes), PLAN)

    def advance(self) -> bool:
        """Land what an earlier run left open, then plan and land one epoch;
        False if no file has anything new."""
        done = self.epochs()
        if done:
            self._land(done[-1])
        epoch = done[-1] + 1 if done else 0
        before = self.positions()
        admitted = scratch_table(self._admitted(before), "tail-admitted")
        if admitted.isEmpty():
            return False
        plan = f"{self.path}/plans/epoch-{epoch}"
        self._plan(admitted).write.mode("overwrite").parquet(plan)
        ends = self.spark.read.schema(PLAN).parquet(plan).filter("last").select(
            "path", F.col("entry").alias("pos"), F.col("first_seq").alias("seq"), F.col("start").alias("seen"),
            F.lit(epoch).cast("long").alias("tried"))
        (before.join(ends, "path", "left_anti").unionByName(ends)
         .write.mode("overwrite").parquet(f"{self.path}/positions/epoch-{epoch}"))
        self.publish(epoch, {"plan": plan})
        self._land(epoch)
        return True

    def _land(self, epoch: int) -> None:
        at, fs = self._fs(f"packets/epoch-{epoch}")
        if fs.exists(at):
            return
        chunks = self.spark.read.schema(PLAN).parquet(self.manifest(epoch)["plan"]).filter("NOT last").drop("last")
        staged, _ = self._fs(f"_landing/epoch-{epoch}")
        (chunks.repartition(tasks_of(chunks)).mapInArrow(_records(False, growing=True), RAW_PACKETS)
         .write.mode("overwrite").parquet(f"{self.path}/_landing/epoch-{epoch}"))
        fs.mkdirs(at.getParent())
        if not fs.rename(staged, at):
            raise OSError(f"packets of epoch {epoch} cannot be landed")

    def drain(self) -> int:
        """Advance until nothing is new; the number of epochs that took."""
        n = 0
        while self.advance():
            n += 1
        return n

    def stream(self, max_files: int | None = None) -> DataFrame:
        """The landed packets as a stream. A micro-batch takes whole epochs
        unless ``max_files`` splits them; then packets of a capture can come
        out of order, which ``run_in_order`` allows for."""
        r = self.spark.readStream.schema(RAW_PACKETS)
        if max_files:
            r = r.option("maxFilesPerTrigger", str(max_files))
        return r.parquet(f"{self.path}/packets/epoch-*")

    def read(self) -> DataFrame:
        """All packets that have landed."""
        landed = [e for e in self.epochs() if self._landed(e)]
        if not landed:
            return self.spark.createDataFrame([], RAW_PACKETS)
        return self.spark.read.schema(RAW_PACKETS).parquet(*[f"{self.path}/packets/epoch-{e}" for e in landed])

    def _landed(self, epoch: int) -> bool:
        at, fs = self._fs(f"packets/epoch-{epoch}")
        return fs.exists(at)

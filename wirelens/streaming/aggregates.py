"""Streaming ingest and live aggregates.

Live aggregates run as native streaming aggregations (partial and final
aggregation, state in the state store). Results are written per
micro-batch with ``foreachBatch`` to a table folder (distributed write, no
driver-side sink), which a batch reader then reads. Aggregates of verdicts
(flow records with ``blocked``, totals with forwarded and dropped packets) are
merged into a ``KeyedTable``, of which an epoch rewrites only what it touches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flows import flow_app, flow_table
from ..schemas import FLOW_KEY, RAW_PACKETS
from ..session import scratch_path, scratch_table
from ..sources.pcap import register


TOTALS = ["total_packets", "total_bytes", "tcp_packets", "udp_packets", "forwarded", "dropped"]


def read_capture_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Capture files dropped into ``path`` as a stream of raw packets."""
    register(spark)
    r = spark.readStream.format("pcap")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def read_packet_table_stream(spark: SparkSession, path: str,
                             max_files: int | None = None) -> DataFrame:
    """A folder of ``raw_packets`` Parquet files as a stream."""
    r = spark.readStream.schema(RAW_PACKETS)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path)


def stream_totals(hosts: DataFrame) -> DataFrame:
    """Live totals per capture (T4)."""
    c = F.col
    return hosts.groupBy("capture_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_packets"),
        F.sum("packet_bytes").cast("bigint").alias("total_bytes"),
        F.count_if(c("is_parsed") & (c("protocol") == 6)).cast("bigint").alias("tcp_packets"),
        F.count_if(c("is_parsed") & (c("protocol") == 17)).cast("bigint").alias("udp_packets"),
    )


def stream_flow_table(hosts: DataFrame) -> DataFrame:
    """Live flow table (T3): the batch flow-table aggregate, unchanged."""
    return flow_table(hosts)


def stream_flow_evictions(hosts: DataFrame, idle: str, delay: str = "0 seconds") -> DataFrame:
    """Flows that leave the table of live flows for being idle (T5), by the
    time of their packets: one row each, with the flow's final record and the
    times of its first and last packet.

    A flow whose next packet is more than ``idle`` later begins anew. It is
    evicted once the watermark, ``delay`` behind the latest packet, has passed
    its last packet by ``idle``; what is not evicted yet has no row. Packets
    may be out of order by ``delay``; later ones are not counted, so this is a
    query of its own and the verdicts (``stream_states``) never evict by time.
    Native session windows: the state is one record a live flow.
    """
    c = F.col
    at = F.timestamp_micros(c("ts_sec") * 1_000_000 + c("ts_usec"))
    live = (hosts.filter(c("is_parsed")).withColumn("at", at).withWatermark("at", delay)
            .groupBy(*FLOW_KEY, F.session_window("at", idle).alias("live")))
    ended = live.agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("packet_bytes").cast("bigint").alias("byte_count"),
        F.min_by("named", "seq").alias("__first"), F.expr("min_by(named, seq) FILTER (WHERE named IS NOT NULL)").alias("__fnn"),
        F.expr("max_by(host, seq) FILTER (WHERE host IS NOT NULL)").alias("host"),
        F.any_value("port_app").alias("__port_app"), F.max("at").alias("last_ts"))
    return ended.select(*FLOW_KEY, "packet_count", "byte_count",
                        flow_app(c("__port_app"), c("__first"), c("__fnn")).alias("app"), "host",
                        c("live.start").alias("first_ts"), "last_ts")


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a new query's state: one a core, and no more than the
    session's shuffles have. An epoch commits every partition's store and
    starts a worker for each, whatever it holds, so a partition more than the
    cores can run at once costs time in all epochs and saves none."""
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(shuffles, max(1, spark.sparkContext.defaultParallelism))


def run_to_table(df: DataFrame, out_path: str | None = None, mode: str = "complete",
                 checkpoint: str | None = None, trigger: str = "availableNow",
                 per_batch: Callable[[DataFrame], DataFrame] | None = None,
                 into: Callable[[DataFrame, int], None] | None = None,
                 partitions: int | None = None) -> str:
    """Run a streaming query until the available input is processed and
    keep its result as a Parquet table.

    ``trigger="availableNow"`` suits sources with admission control (file
    sources); ``"drain"`` runs back-to-back micro-batches until the source
    reports no new data (Python sources, which cap batches themselves).

    ``complete`` mode overwrites the table with each batch's full result;
    ``append`` mode appends each batch's new rows. With ``per_batch`` a batch
    is written once and what the function makes of it is the result; with
    ``into`` that goes to a sink of its own (``KeyedTable.upsert``). Both work
    on the written batch in the session of ``df``, so adaptive execution, which
    Spark turns off in a stream's own session, fits their jobs to its size.

    ``partitions`` (``state_partitions`` by default) is the number of the
    state's partitions; a checkpoint keeps the one it began with.
    """
    spark = df.sparkSession
    out_path = out_path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")

    def sink(batch: DataFrame, epoch: int) -> None:
        # idempotent per epoch, so a retried batch never duplicates rows
        if per_batch is not None:  # what reads it twice must not run the stateful step twice
            batch = per_batch(scratch_table(batch, "micro-batch", spark))
        if into is not None:
            into(batch, epoch)
        elif mode == "complete":
            batch.write.mode("overwrite").parquet(out_path)
        else:
            batch.write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    w = (df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    # read when the query starts, from then on its own
    settings = {"spark.sql.shuffle.partitions": str(partitions or state_partitions(spark))}
    if trigger == "availableNow":
        # a catch-up run ends when the input is consumed, however long that takes;
        # with state TTL the engine would otherwise keep running cleanup batches
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime="0 seconds")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if trigger == "availableNow":
        q.awaitTermination()
    else:
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    if q.exception() is not None:
        raise q.exception()
    return out_path


class EpochLog:
    """A folder whose epochs become visible one by one, each by its manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        """Epochs whose manifests stand."""
        at, fs = self._fs("_manifests")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def manifest(self, epoch: int) -> dict:
        at, fs = self._fs(f"_manifests/{epoch}.json")
        part = fs.open(at)
        try:
            return json.loads(bytes(part.readAllBytes()))
        finally:
            part.close()

    def publish(self, epoch: int, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        part, fs = self._fs(f"_manifests/{epoch}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{epoch}.json")):
            raise OSError(f"manifest of epoch {epoch} cannot be published")

    def forget(self, name: str) -> None:
        """Delete a folder that no later epoch reads."""
        at, fs = self._fs(name)
        fs.delete(at, True)

    @staticmethod
    def columns_of(df: DataFrame) -> str:
        return df.schema.simpleString()[len("struct<"):-1].replace(":", " ")


class KeyedTable(EpochLog):
    """A table of one row per key that micro-batches are merged into.

    Rows lie in ``buckets`` folders by a hash of the key. An epoch merges its
    rows with those of the buckets it touches, writes these buckets anew under
    its own folder and then its manifest, which names the folder of every
    bucket. Readers see the last manifest only, so an epoch is visible whole
    or not at all, untouched buckets are never rewritten, and an epoch that is
    run again after its manifest stands changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str],
                 merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        super().__init__(spark, path)
        self.keys, self.merge, self.buckets = keys, merge, buckets

    def _rows(self, manifest: dict) -> DataFrame:
        if not manifest["buckets"]:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*sorted(manifest["buckets"].values()))

    def upsert(self, rows: DataFrame, epoch: int) -> None:
        done = self.epochs()
        if epoch in done:
            return
        before = self.manifest(done[-1]) if done else {"buckets": {}}
        new = scratch_table(self.merge(rows).withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))), "upsert")
        touched = {str(r[0]) for r in new.select("__bucket").distinct().collect()}  # at most ``buckets``
        old = {b: p for b, p in before["buckets"].items() if b in touched}
        cols = [x for x in new.columns if x != "__bucket"]
        merged = new.select(*cols)
        if old:
            merged = self.merge(merged.unionByName(self._rows({**before, "buckets": old}).select(*cols)))
        out = f"{self.path}/epoch-{epoch}"
        (merged.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)))
         .repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(out))
        self.publish(epoch, {"schema": self.columns_of(merged),
                             "buckets": {**before["buckets"], **{b: f"{out}/__bucket={b}" for b in touched}}})

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table as of the last epoch (of those below ``before``); None before the first."""
        done = [e for e in self.epochs() if before is None or e < before]
        return self._rows(self.manifest(done[-1])) if done else None


def merge_flows(rows: DataFrame) -> DataFrame:
    """Live flow records (T3): of verdicts (one row per packet) or of records."""
    c = F.col
    packet = "packet_count" not in rows.columns
    last = c("seq") if packet else c("last_seq")
    return rows.filter(c("is_parsed") if packet else F.lit(True)).groupBy(*FLOW_KEY).agg(
        (F.count(F.lit(1)) if packet else F.sum("packet_count")).cast("bigint").alias("packet_count"),
        F.max("flow_bytes" if packet else "byte_count").cast("bigint").alias("byte_count"),
        F.max_by(c("app_state" if packet else "app"), last).alias("app"),
        F.max_by(c("host_state" if packet else "host"), last).alias("host"),
        F.bool_or("blocked").alias("blocked"),
        F.max(last).alias("last_seq"))


def merge_totals(rows: DataFrame) -> DataFrame:
    """Live totals per capture (T4) with forwarded and dropped packets: of
    verdicts joined with ``packet_bytes`` and ``protocol``, or of totals."""
    c = F.col
    if "total_packets" in rows.columns:
        sums = {x: F.sum(x) for x in TOTALS}
    else:
        sums = dict(zip(TOTALS, [
            F.count(F.lit(1)), F.sum("packet_bytes"), F.count_if(c("is_parsed") & (c("protocol") == 6)),
            F.count_if(c("is_parsed") & (c("protocol") == 17)), F.count_if(~c("blocked")), F.count_if(c("blocked"))]))
    return rows.groupBy("capture_id").agg(*[v.cast("bigint").alias(k) for k, v in sums.items()])

"""State partitions of a stream, and the session its micro-batches are worked on in."""

import os

from pyspark.sql import functions as F

from wirelens.streaming import forward
from wirelens.streaming.aggregates import read_packet_table_stream, run_to_table, state_partitions
from wirelens.schemas import RAW_PACKETS


def _drop(spark, path, n=40):
    rows = [("c", i, 1, 0, 4, 4, bytearray(b"\0\1\2\3")) for i in range(n)]
    spark.createDataFrame(rows, RAW_PACKETS).repartition(4).write.parquet(path)
    return read_packet_table_stream(spark, path, max_files=2)


def _state_folders(checkpoint):
    return [x for x in os.listdir(f"{checkpoint}/state/0") if x.isdigit()]


def test_state_has_a_partition_a_core_at_most(spark, tmpdir_path):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    for shuffles, asked, expected in ((64, None, spark.sparkContext.defaultParallelism), (2, None, 2), (64, 7, 7)):
        ckpt = f"{tmpdir_path}/ckpt-{shuffles}-{asked}"
        stream = _drop(spark, f"{tmpdir_path}/drop-{shuffles}-{asked}").groupBy((F.col("seq") % 10).alias("k")).count()
        spark.conf.set(key, str(shuffles))
        try:
            out = run_to_table(stream, f"{tmpdir_path}/out-{shuffles}-{asked}", checkpoint=ckpt, partitions=asked)
            assert spark.conf.get(key) == str(shuffles)
            assert asked or state_partitions(spark) == expected
        finally:
            spark.conf.set(key, before)
        assert len(_state_folders(ckpt)) == expected
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(k, 4) for k in range(10)]


def test_micro_batches_are_worked_on_in_the_adaptive_session(spark, tmpdir_path):
    seen = []

    def look(batch, epoch):
        seen.append((batch.sparkSession.conf.get("spark.sql.adaptive.enabled"), batch.count()))

    run_to_table(_drop(spark, f"{tmpdir_path}/drop"), mode="append", per_batch=lambda batch: batch, into=look)
    assert [s for s, _n in seen] == ["true", "true"] and sum(n for _s, n in seen) == 40


def test_verdicts_of_a_forwarded_epoch_are_made_once(spark, tmpdir_path, monkeypatch):
    split = []
    monkeypatch.setattr(forward, "split_packets", lambda raw, v: split.append(v) or (raw, raw.limit(0)))
    forward.forward_stream(_drop(spark, f"{tmpdir_path}/drop"))
    assert split and all(len(v.inputFiles()) > 0 and "Scan parquet" in v._jdf.queryExecution().executedPlan().toString()
                         and "Join" not in v._jdf.queryExecution().executedPlan().toString()
                         and v.columns == ["capture_id", "seq", "blocked"] for v in split)

"""Micro-batches of several small files, and the state handler on rows."""

import os

from pyspark.sql import Row

from wirelens.plans.io_queries import STREAM_BATCH_ROWS, STREAM_FILE_ROWS, stream_batch_files
from wirelens.streaming.state import INPUT_COLUMNS, FlowStateProcessor


def test_many_small_files_make_few_micro_batches(spark, tmpdir_path):
    for n, expected in ((1, 1), (4, 1), (24, 6), (240, STREAM_BATCH_ROWS // STREAM_FILE_ROWS)):
        path = os.path.join(tmpdir_path, f"drop-{n}")
        os.makedirs(path)
        for k in range(n):
            open(os.path.join(path, f"part-{k:05d}.parquet"), "w").close()
        open(os.path.join(path, "_SUCCESS"), "w").close()
        assert stream_batch_files(spark, path) == expected


class Kept:
    """A value state that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_handler_takes_rows_and_asks_its_state_twice_a_flow():
    key = ("c", 1, 2, 3, 80, 6)

    def row(seq, named, host):
        return Row(*INPUT_COLUMNS)(*key, seq, named, host, "HTTP", 10)

    p = FlowStateProcessor()
    p.state = Kept()
    out = list(p.handleInputRows(key, iter([row(2, None, None), row(0, None, "a"), row(1, "YouTube", None)]), None))
    assert [(r.seq, r.app_state, r.host_state, r.flow_packets, r.flow_bytes) for r in out] == [
        (0, "HTTP", "a", 1, 10), (1, "YouTube", "a", 2, 20), (2, "YouTube", "a", 3, 30)]
    assert p.state.calls == 2
    out = list(p.handleInputRows(key, iter([row(3, "Google", "b")]), None))
    assert [(r.app_state, r.host_state, r.flow_packets, r.packet_bytes) for r in out] == [("YouTube", "b", 4, 10)]
    assert p.state.calls == 4 and p.state.value == ("YouTube", "b", 4, 40)

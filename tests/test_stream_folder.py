"""The drop folder of the streams: the packets of ``events``, dealt as events."""

import os

import pytest

from wirelens.plans import io_queries
from wirelens.sources import events


@pytest.mark.parametrize("shuffled", [False, True])
def test_drop_folder_has_the_derived_packets_in_order(spark, tmpdir_path, monkeypatch, shuffled):
    """No table of frames is written and dealt anew before the folder's files."""
    rows = spark.range(0, 3000, 1, 3).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 37 AS user_id",
        "element_at(array('view', 'click', 'error', 'purchase', 'signup'), CAST(id % 5 + 1 AS int)) AS event_type")
    rows.write.parquet(os.path.join(tmpdir_path, "events.parquet"))
    monkeypatch.setattr(io_queries, "STREAM_FILE_ROWS", 500)
    monkeypatch.setattr(io_queries, "packets", lambda *a: 1 / 0)
    path = io_queries.stream_folder(spark, tmpdir_path, shuffled)
    got = spark.read.parquet(path)
    want = events.packets_from_events(events.load_events(spark, tmpdir_path))
    assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and got.count() == 3000
    parts = sorted(f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-"))
    files = [[r.seq for r in spark.read.parquet(os.path.join(path, f)).collect()] for f in parts]
    assert len(files) == 6 and max(map(len, files)) < 1000
    if not shuffled:
        assert [s for f in files for s in f] == list(range(3000))

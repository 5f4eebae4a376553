"""Captures that grow while they are read: no packet lost, none twice."""

import os
import random
import struct

import pytest
from frames import frame

from wirelens.sources.pcap import read_pcap
from wirelens.streaming.tail import CaptureTail

SNAPLEN = 2000


def capture(n, seed, fake=False):
    """Bytes of a capture; ``fake``: payloads that hold headers of records."""
    r = random.Random(seed)
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, SNAPLEN, 1)]
    for i in range(n):
        body = b"".join(struct.pack("<IIiI", 1000 + i, 5, 40, 40) for _ in range(9)) if fake else r.randbytes(r.randint(0, 300))
        data = frame("10.0.0.1", "10.0.0.2", 1000 + i, 80, payload=body)
        out.append(struct.pack("<IIiI", 1000 + i, i, len(data), len(data)) + data)
    return b"".join(out)


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def rows(df):
    return sorted(tuple(x) for x in df.select("capture_id", "seq", "ts_sec", "ts_usec", "incl_len", "orig_len", "data").collect())


def test_growing_files(spark, tmpdir_path):
    folder, log = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "log")
    files = {"a.pcap": capture(120, 1), "b/a.pcap": capture(60, 2, fake=True), "c.pcap": capture(3, 3)}
    cuts = {"a.pcap": (10, 24, 9000, 9007, None), "b/a.pcap": (700, 708, 720, 12000, None), "c.pcap": (0, 0, 0, 24, None)}
    at = dict.fromkeys(files, 0)
    for step in range(5):
        for name, data in files.items():
            end = cuts[name][step] if cuts[name][step] is not None else len(data)
            append(os.path.join(folder, name), data[at[name]:end])
            at[name] = end
        # a new reader each time, small epochs and ranges
        tail = CaptureTail(spark, folder, log, max_bytes=6000, range_bytes=1024)
        tail.drain()
        assert not tail.advance()
        if step == 2:
            assert len(rows(tail.read())) < 100
    got = rows(tail.read())
    assert got == rows(read_pcap(spark, folder)) and len(got) == 183
    assert {os.path.basename(r.path): 0 for r in tail.positions().collect()}.keys() == {"a.pcap", "c.pcap"}
    assert all(r.pos == r.seen for r in tail.positions().collect())


def test_first_epoch_is_bounded(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "in")
    for i in range(4):
        append(os.path.join(folder, f"{i}.pcap"), capture(50, i))
    tail = CaptureTail(spark, folder, os.path.join(tmpdir_path, "log"), max_bytes=3000, range_bytes=1000)
    assert tail.advance()
    first = rows(tail.read())
    assert 0 < sum(16 + r[4] for r in first) <= 3000 + 16 + SNAPLEN
    tail.advance()
    assert {r[0] for r in rows(tail.read())} != {r[0] for r in first}  # the others' turn
    tail.drain()
    assert rows(tail.read()) == rows(read_pcap(spark, folder))


def test_crashes(spark, tmpdir_path, monkeypatch):
    """A reader that dies behind the plan, before its manifest, or before its packets have landed."""
    folder, log = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "log")
    data = capture(80, 4)
    append(os.path.join(folder, "a.pcap"), data[:5000])
    for step in ("publish", "_land"):
        with monkeypatch.context() as m:
            m.setattr(CaptureTail, step, lambda *a: (_ for _ in ()).throw(OSError("stop")))
            with pytest.raises(OSError):
                CaptureTail(spark, folder, log).advance()
        assert rows(CaptureTail(spark, folder, log).read()) == []
    append(os.path.join(folder, "a.pcap"), data[5000:])
    tail = CaptureTail(spark, folder, log)
    tail.drain()
    assert rows(tail.read()) == rows(read_pcap(spark, folder)) and len(rows(tail.read())) == 80


def test_damage_and_shrinking_fail(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "in")
    data = bytearray(capture(20, 5))
    append(os.path.join(folder, "a.pcap"), data)
    tail = CaptureTail(spark, folder, os.path.join(tmpdir_path, "log"))
    assert tail.drain() == 1
    os.truncate(os.path.join(folder, "a.pcap"), 100)
    with pytest.raises(Exception, match="shorter"):
        tail.advance()
    struct.pack_into("<i", data, 24 + 8, -1)
    append(os.path.join(folder, "x", "b.pcap"), data)
    with pytest.raises(Exception, match="no record begins at byte 24"):
        CaptureTail(spark, os.path.join(folder, "x"), os.path.join(tmpdir_path, "log2")).advance()


def test_record_up_to_the_end_of_the_file(spark, tmpdir_path):
    """The epoch's bytes end within the last record: nothing is left for another."""
    folder = os.path.join(tmpdir_path, "in")
    append(os.path.join(folder, "a.pcap"), capture(1, 6))
    tail = CaptureTail(spark, folder, os.path.join(tmpdir_path, "log"), max_bytes=10)
    assert tail.drain() == 1 and rows(tail.read()) == rows(read_pcap(spark, folder))


def test_nothing_there(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "in")
    append(os.path.join(folder, "a.pcap"), b"")
    tail = CaptureTail(spark, folder, os.path.join(tmpdir_path, "log"))
    assert tail.drain() == 0 and tail.read().count() == 0 and tail.positions().count() == 0

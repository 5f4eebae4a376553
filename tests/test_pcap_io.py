"""Capture source and sink (S1-S3), inventory and split reading."""

import os
import struct

import pytest
from frames import frame, raw_df

from wirelens.sources.inventory import capture_inventory
from wirelens.sources.pcap import read_pcap, register, write_pcap
from wirelens.sources.ranges import read_pcap_errors


def write_file(path, records, big_endian=False, magic=None, link=1, snaplen=65535, tail=b""):
    bo = ">" if big_endian else "<"
    with open(path, "wb") as f:
        m = magic if magic is not None else 0xA1B2C3D4
        f.write(struct.pack(bo + "IHHiiII", m, 2, 4, 0, 0, snaplen, link))
        for sec, usec, data in records:
            f.write(struct.pack(bo + "IIII", sec, usec, len(data), len(data)) + data)
        f.write(tail)


def frames3():
    return [frame("10.0.0.1", "10.0.0.2", 1000 + i, 80, payload=b"x" * i) for i in range(3)]


def test_write_read_equal(spark, tmpdir_path):
    raw = raw_df(spark, frames3() * 50, capture_id="cap1")
    out = os.path.join(tmpdir_path, "out")
    write_pcap(raw, out, partitions=3)
    back = read_pcap(spark, out)
    a = sorted((r.seq, r.ts_sec, r.ts_usec, bytes(r.data)) for r in raw.collect())
    b = sorted((r.seq, r.ts_sec, r.ts_usec, bytes(r.data)) for r in back.collect())
    assert [x[1:] for x in a] == [x[1:] for x in b]          # same records, same order
    assert {r.capture_id for r in back.collect()} == {"cap1"}
    files = sorted(os.listdir(os.path.join(out, "cap1")))
    assert files and all(f.startswith("part-") for f in files)
    with open(os.path.join(out, "cap1", files[0]), "rb") as f:
        head = f.read(24)
    assert struct.unpack("<IHHiiII", head) == (0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)


def test_big_endian_and_tail(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "be.pcap")
    write_file(p, [(5, 6, f) for f in frames3()], big_endian=True, tail=b"\x00" * 7)
    rows = read_pcap(spark, p).orderBy("seq").collect()
    assert [(r.seq, r.ts_sec, r.ts_usec, r.capture_id) for r in rows] == [
        (0, 5, 6, "be"), (1, 5, 6, "be"), (2, 5, 6, "be")]
    assert bytes(rows[2].data) == frames3()[2]


@pytest.mark.parametrize("kind", ["magic", "link", "snaplen", "cut"])
def test_failfast_and_permissive(spark, tmpdir_path, kind):
    p = os.path.join(tmpdir_path, f"{kind}.pcap")
    recs = [(1, 2, f) for f in frames3()]
    if kind == "magic":
        write_file(p, recs, magic=0xA1B23C4D)
    elif kind == "link":
        write_file(p, recs, link=101)
    elif kind == "snaplen":
        write_file(p, recs, snaplen=40)
    else:
        write_file(p, recs)
        with open(p, "r+b") as f:
            f.truncate(os.path.getsize(p) - 3)
    with pytest.raises(Exception):
        read_pcap(spark, p).collect()
    n = read_pcap(spark, p, mode="PERMISSIVE").count()
    assert n == {"magic": 0, "link": 0, "snaplen": 0, "cut": 2}[kind]
    inv = capture_inventory(spark, tmpdir_path).collect()
    assert all(r.error for r in inv if r.path.endswith(f"{kind}.pcap"))


def looks_like_records(k):
    """A payload made of record headers of its own, of zeros, or of both."""
    return [struct.pack("<IIII", 1, 2, 30, 30) * 20, b"\x00" * 700, struct.pack("<IIII", 9, 9, 0, 0) * 9 + b"\x00" * 30][k % 3]


@pytest.mark.parametrize("big_endian", [False, True])
def test_ranges_of_any_size_equal_one_pass(spark, tmpdir_path, big_endian):
    p = os.path.join(tmpdir_path, "big.pcap")
    recs = [(i, i % 1000000, frame("10.0.0.1", "10.0.0.2", 1, 80, payload=looks_like_records(i) if i % 4 else b"x" * (i % 90))) for i in range(120)]
    write_file(p, recs, big_endian=big_endian, snaplen=2000, tail=b"\x01" * 5)
    inv = capture_inventory(spark, p).collect()[0]
    assert (inv.n_packets, inv.link_type, inv.error) == (120, 1, None)
    register(spark)
    whole = sorted(map(tuple, spark.read.format("pcap").load(p).collect()))
    assert [(r[2], r[3], bytes(r[6])) for r in whole] == recs
    for size in (600, 3000, 40_000, 1 << 20):  # below a record, a few records, many, the file
        assert sorted(map(tuple, read_pcap(spark, p, range_bytes=size).collect())) == whole, size


def test_damage_is_passed_over(spark, tmpdir_path):
    """Packets behind a damaged record are read and counted, with an error row
    for each stretch; FAILFAST fails, wherever the ranges lie."""
    p = os.path.join(tmpdir_path, "hurt.pcap")
    recs = [(i, i, frame("10.0.0.1", "10.0.0.2", 1, 80, payload=b"y" * (i % 50))) for i in range(300)]
    write_file(p, recs)
    at = [24]
    for _, _, d in recs:
        at.append(at[-1] + 16 + len(d))
    with open(p, "r+b") as f:
        for k in (50, 51, 200):
            f.seek(at[k] + 8)
            f.write(struct.pack("<i", -5))
        f.truncate(at[300] - 4)
    kept = [r for k, r in enumerate(recs) if k not in (50, 51, 200, 299)]
    for size in (5000, 1 << 20):
        with pytest.raises(Exception):
            read_pcap(spark, p, range_bytes=size).collect()
        rows = sorted(read_pcap(spark, p, mode="PERMISSIVE", range_bytes=size).collect(), key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(296))
        assert [(r.ts_sec, r.ts_usec, bytes(r.data)) for r in rows] == kept
        errors = sorted((r.offset, r.length) for r in read_pcap_errors(spark, p, range_bytes=size).collect())
        lost = {b for o, n in errors for b in range(o, o + n)}
        assert lost == {b for k in (50, 51, 200, 299) for b in range(at[k], min(at[k + 1], at[300] - 4))}


def test_equal_names_in_folders_are_captures_of_their_own(spark, tmpdir_path):
    for folder, n in (("a", 2), ("b", 3)):
        os.mkdir(os.path.join(tmpdir_path, folder))
        write_file(os.path.join(tmpdir_path, folder, "x.pcap"), [(1, 2, f) for f in frames3()[:n]])
    register(spark)
    for df in (read_pcap(spark, tmpdir_path), spark.read.format("pcap").load(tmpdir_path)):
        assert sorted((r.capture_id, r.seq) for r in df.collect()) == [("a/x", 0), ("a/x", 1), ("b/x", 0), ("b/x", 1), ("b/x", 2)]


def test_small_ranges_share_tasks_and_give_a_row_each(spark, tmpdir_path):
    """Ranges far smaller than ``TASK_BYTES`` are read by few tasks, and the
    chains of a range, however many, are one row."""
    from wirelens.sources import ranges

    p = os.path.join(tmpdir_path, "small", "a.pcap")
    os.makedirs(os.path.dirname(p))
    body = b"".join(struct.pack("<IIiI", 100 + i, 5, 60, 60) + bytes(60) for i in range(3000))
    with open(p, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body)
    found = ranges._ranges(spark, p, "*.pcap", 1 << 10, None)
    n = found.count()
    cores = spark.sparkContext.defaultParallelism
    assert n > 200 and ranges.tasks_of(found) == cores
    chains = found.repartition(cores).mapInPandas(ranges._chains(False), ranges.CHAINS).collect()
    assert len(chains) == n and max(len(r.entries) for r in chains) > 10
    df = read_pcap(spark, p, range_bytes=1 << 10)
    assert df.rdd.getNumPartitions() == cores
    assert [(r.seq, r.ts_sec) for r in df.orderBy("seq").collect()] == [(i, 100 + i) for i in range(3000)]

"""Capture files as a Spark data source.

``spark.read.format("pcap").load(path)`` reads classic capture files
(24-byte global header, then 16-byte record headers and frame bytes) into
``raw_packets`` rows: ``capture_id`` (the file name without extension, or
the ``capture_id`` option), ``seq`` (record number in the file), the two
timestamp words, both lengths and the frame bytes. Each file is one input
partition, read on an executor and returned as Arrow batches; nothing passes
through the driver but the file list.

``df.write.format("pcap").save(dir)`` writes ``<dir>/<capture_id>/part-NNNNN.pcap``,
one file per (capture, task)
in little-endian byte order, version 2.4, snaplen 65535, link type 1, with
``orig_len = incl_len`` and 32-bit timestamps. Files are written under a
``_temporary`` folder and moved into place by the driver's commit, so a
lost or retried task never leaves a partial capture behind.

``spark.readStream.format("pcap").load(dir)`` treats a folder as a drop box:
each micro-batch takes the files that appeared since the last one, in name
order (one partition per file).

Options: ``mode`` = ``FAILFAST`` (default: a bad header or a cut record
body fails the task) or ``PERMISSIVE`` (keep the records before the
damage); ``capture_id`` (fixed id for every file); ``pathGlobFilter``
(default ``*.pcap``); ``maxFilesPerTrigger`` (streaming).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from ..schemas import RAW_PACKETS

# --- fixed values of the capture format -------------------------------------
MAGIC_BE = 0xA1B2C3D4        # as read big-endian: big-endian file
MAGIC_LE = 0xD4C3B2A1        # as read big-endian: little-endian file
GLOBAL_HEADER = 24
RECORD_HEADER = 16
LINKTYPE_ETHERNET = 1
WRITE_VERSION = (2, 4)
WRITE_SNAPLEN = 65535
# ---------------------------------------------------------------------------

BATCH_ROWS = 8192


class CaptureError(IOError):
    pass


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def _open(path: str, mode: str = "rb"):
    p = _local(path)
    if "://" in p:
        try:
            import fsspec  # optional, for remote file systems
        except ImportError as e:  # pragma: no cover
            raise CaptureError(f"no file system for {path!r} (install fsspec)") from e
        return fsspec.open(p, mode).open()
    return open(p, mode)


def list_captures(path: str, glob_filter: str = "*.pcap") -> list[str]:
    """Files under ``path`` (a file, a folder or a glob), sorted by name."""
    import fnmatch
    import glob
    import os

    p = _local(path)
    if any(ch in p for ch in "*?["):
        files = glob.glob(p, recursive=True)
    elif os.path.isdir(p):
        files = []
        for root, dirs, names in os.walk(p):
            dirs[:] = sorted(d for d in dirs if not d.startswith(("_", ".")))
            files += [os.path.join(root, n) for n in names
                      if fnmatch.fnmatch(n, glob_filter) and not n.startswith(("_", "."))]
    else:
        files = [p]
    return sorted(files)


PART_SHIFT = 40


def capture_of(path: str, root: str | None = None) -> tuple[str, int]:
    """(capture id, first seq) of a file. Files written by this library are
    ``<capture_id>/part-NNNNN-<job>.pcap`` (parts in seq order), so the id is the
    folder name and the part number is the high part of ``seq``; any other
    file is its own capture named after the file. Below ``root``, the folder
    that is read, names keep their folders, so equal names don't meet."""
    import os
    import re

    folder, base = os.path.split(path)
    below = os.path.relpath(folder, root) if root else "."
    below = "" if below == "." or below.startswith("..") else below
    m = re.fullmatch(r"part-(\d+)(?:-[0-9a-f]+)?\.pcap", base)
    if m:
        return below or os.path.basename(folder), int(m.group(1)) << PART_SHIFT
    return os.path.join(below, base.rsplit(".", 1)[0] if "." in base else base), 0


def capture_name(path: str) -> str:
    return capture_of(path)[0]


def read_global_header(head: bytes) -> tuple[str, int, int, int, int]:
    """-> (byte order '<' or '>', major, minor, snaplen, link type)."""
    import struct

    if len(head) < GLOBAL_HEADER:
        raise CaptureError("unexpected end of file in the global header")
    magic = struct.unpack(">I", head[:4])[0]
    if magic == MAGIC_BE:
        bo = ">"
    elif magic == MAGIC_LE:
        bo = "<"
    else:
        raise CaptureError(f"not a capture file: it begins with {magic:08x}")
    major, minor, _zone, _sig, snaplen, link = struct.unpack(bo + "HHiiII", head[4:24])
    if link != LINKTYPE_ETHERNET:
        raise CaptureError(f"unsupported link type: {link}")
    return bo, major, minor, snaplen, link


def iter_records(f, bo: str, snaplen: int, permissive: bool):
    """Yield (ts_sec, ts_usec, incl_len, orig_len, data) from an open file
    positioned after the global header. A short record header is a clean
    end; a record body cut short is an error (or the end, if permissive)."""
    import struct

    hdr = struct.Struct(bo + "IIiI")
    while True:
        h = f.read(RECORD_HEADER)
        if len(h) < RECORD_HEADER:
            return
        ts_sec, ts_usec, incl, orig = hdr.unpack(h)
        if incl < 0 or incl > snaplen:
            if permissive:
                return
            raise CaptureError(f"record of {incl} bytes, {snaplen} allowed")
        data = f.read(incl)
        if len(data) < incl:
            if permissive:
                return
            raise CaptureError("file ends within a record")
        yield ts_sec, ts_usec, incl, orig, data


def _batches(path: str, capture_id: str | None, permissive: bool, root: str):
    import pyarrow as pa

    from .ranges import root_of

    schema = pa.schema([
        ("capture_id", pa.string()), ("seq", pa.int64()), ("ts_sec", pa.int64()),
        ("ts_usec", pa.int64()), ("incl_len", pa.int32()), ("orig_len", pa.int32()),
        ("data", pa.binary()),
    ])
    cap, seq0 = capture_of(path, root_of(root))
    cap = capture_id if capture_id is not None else cap
    with _open(path) as f:
        try:
            bo, _ma, _mi, snaplen, _link = read_global_header(f.read(GLOBAL_HEADER))
        except CaptureError:
            if permissive:
                return
            raise
        cols = ([], [], [], [], [], [])
        seq = seq0
        for rec in iter_records(f, bo, snaplen, permissive):
            cols[0].append(seq)
            for i in range(5):
                cols[i + 1].append(rec[i])
            seq += 1
            if len(cols[0]) >= BATCH_ROWS:
                yield _to_batch(schema, cap, cols)
                cols = ([], [], [], [], [], [])
        if cols[0]:
            yield _to_batch(schema, cap, cols)


def _to_batch(schema, cap, cols):
    import pyarrow as pa

    n = len(cols[0])
    return pa.RecordBatch.from_arrays([
        pa.array([cap] * n, pa.string()), pa.array(cols[0], pa.int64()),
        pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
        pa.array(cols[3], pa.int32()),
        pa.array([min(o, 0x7FFFFFFF) for o in cols[4]], pa.int32()),
        pa.array(cols[5], pa.binary()),
    ], schema=schema)


@dataclass
class CaptureFile(InputPartition):
    path: str


def _options(opts) -> tuple[bool, str | None, str]:
    mode = str(opts.get("mode", "FAILFAST")).upper()
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be FAILFAST or PERMISSIVE, not {mode}")
    return mode == "PERMISSIVE", opts.get("capture_id"), opts.get("pathGlobFilter", "*.pcap")


class PcapReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("pcap source needs a path")
        self.permissive, self.capture_id, self.glob = _options(options)

    def partitions(self):
        return [CaptureFile(p) for p in list_captures(self.path, self.glob)]

    def read(self, partition):
        yield from _batches(partition.path, self.capture_id, self.permissive, self.path)


class PcapStreamReader(DataSourceStreamReader):
    """Files in the order of (change time, path); an offset is the last file
    taken. A file moved or written into the folder later has a later change
    time whatever its name, so none is lost or repeated over restarts; files
    must be complete when they appear (move them in) and stay untouched."""

    def __init__(self, options):
        self.path = options.get("path")
        self.permissive, self.capture_id, self.glob = _options(options)
        m = options.get("maxFilesPerTrigger")
        self.max_files = int(m) if m else None
        self._start = None  # the last offset reported, unknown at a start

    def _files(self):
        import os

        return sorted((os.stat(p).st_ctime_ns, p) for p in list_captures(self.path, self.glob))

    @staticmethod
    def _key(offset):
        return offset["changed"], offset["path"]

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def latestOffset(self):
        # Spark doesn't say where the query stands (no read limit, and on a new
        # query this comes before initialOffset): the first call admits all
        # files there are, later ones maxFilesPerTrigger more than the last
        files = self._files()
        if self.max_files is not None and self._start is not None:
            files = [f for f in files if f > self._start][:self.max_files]
        last = files[-1] if files else self._start or (-1, "")
        self._start = max(self._start or last, last)
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start, end):
        return [CaptureFile(f[1]) for f in self._files() if self._key(start) < f <= self._key(end)]

    def commit(self, end):
        self._start = max(self._start or self._key(end), self._key(end))

    def read(self, partition):
        yield from _batches(partition.path, self.capture_id, self.permissive, self.path)


@dataclass
class WrittenFiles(WriterCommitMessage):
    moves: list  # [(temporary path, final path)]


class PcapWriter(DataSourceArrowWriter):
    """Part files have names of their own job and numbers after those that
    are there, so that appended packets follow the earlier ones and no commit
    replaces a file. An overwrite drops the earlier files when the new ones
    stand; a job that fails leaves the folder as it was."""

    def __init__(self, options, overwrite: bool):
        import uuid

        self.path = _local(options.get("path"))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]
        self.old = self._parts()
        numbers = [capture_of(p)[1] >> PART_SHIFT for p in self.old]
        self.first = 0 if overwrite or not numbers else max(numbers) + 1

    def _parts(self):
        import os

        return list_captures(self.path) if os.path.isdir(self.path) else []

    def _temporary(self):
        import os

        return os.path.join(self.path, "_temporary", self.job)

    def write(self, iterator):
        import os
        import struct
        import uuid

        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        tmp_dir = os.path.join(self._temporary(), uuid.uuid4().hex)
        os.makedirs(tmp_dir, exist_ok=True)
        head = struct.pack("<IHHiiII", MAGIC_BE, WRITE_VERSION[0], WRITE_VERSION[1], 0, 0,
                           WRITE_SNAPLEN, LINKTYPE_ETHERNET)
        rec = struct.Struct("<IIII")
        # rows come by capture: one file is open at a time, and opened again if its capture comes back
        files, moves, last, f = {}, [], None, None
        try:
            for batch in iterator:
                d = batch.to_pydict()
                caps = d.get("capture_id") or ["capture"] * batch.num_rows
                for cap, sec, usec, data in zip(caps, d["ts_sec"], d["ts_usec"], d["data"]):
                    cap = cap if cap is not None else "capture"
                    if f is None or cap != last:
                        if f is not None:
                            f.close()
                        new = cap not in files
                        if new:
                            files[cap] = os.path.join(tmp_dir, f"{len(files)}.pcap")
                            moves.append((files[cap], os.path.join(self.path, cap, f"part-{self.first + pid:05d}-{self.job}.pcap")))
                        last, f = cap, open(files[cap], "ab")
                        if new:
                            f.write(head)
                    if data is None:  # the mark of a capture without packets
                        continue
                    n = len(data)
                    f.write(rec.pack((sec or 0) & 0xFFFFFFFF, (usec or 0) & 0xFFFFFFFF, n, n))
                    f.write(data)
        finally:
            if f is not None:
                f.close()
        return WrittenFiles(moves)

    def commit(self, messages):
        import os
        import shutil

        for m in messages:
            if m is None:
                continue
            for tmp, final in m.moves:
                os.makedirs(os.path.dirname(final), exist_ok=True)
                os.rename(tmp, final)
        if self.overwrite:
            for p in self.old:
                os.unlink(p)
        shutil.rmtree(self._temporary(), ignore_errors=True)

    def abort(self, messages):
        import os
        import shutil

        shutil.rmtree(self._temporary(), ignore_errors=True)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return RAW_PACKETS

    def reader(self, schema):
        return PcapReader(self.options)

    def streamReader(self, schema):
        return PcapStreamReader(self.options)

    def writer(self, schema, overwrite):
        return PcapWriter(self.options, overwrite)


def register(spark) -> None:
    """Make ``format("pcap")`` available in this session (idempotent)."""
    spark.dataSource.register(PcapDataSource)


def read_pcap(spark, path: str, **options):
    """``raw_packets`` of the captures under ``path``, read by byte ranges
    (``ranges.read_ranges``, which takes the same options)."""
    from .ranges import read_ranges

    register(spark)
    return read_ranges(spark, path, **options)


def write_pcap(df, path: str, mode: str = "append", partitions: int | None = None, captures=None) -> None:
    """Write ``raw_packets`` rows as capture files, in ``seq`` order per
    capture. Rows are range-partitioned on (capture_id, seq), so each task
    writes consecutive packets of a capture and a capture larger than one
    task spans several ordered part files. ``captures`` (``capture_id``, any
    number of rows) names captures that get a file even without a packet,
    of a header alone."""
    from pyspark.sql import functions as F

    register(df.sparkSession)
    cols = ["capture_id", "seq", "ts_sec", "ts_usec", "data"]
    out = df.select(*cols)
    if captures is not None:
        none = captures.select("capture_id").distinct().join(df.select("capture_id").distinct(), "capture_id", "left_anti")
        out = out.union(none.select("capture_id", *[F.lit(None).cast(df.schema[x].dataType).alias(x) for x in cols[1:]]))
    out = (out.repartitionByRange(partitions, "capture_id", "seq") if partitions
           else out.repartitionByRange("capture_id", "seq"))
    out.sortWithinPartitions("capture_id", "seq").write.format("pcap").mode(mode).save(path)

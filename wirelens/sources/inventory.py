"""Capture inventory (S2) as a Spark job over the file listing: Spark lists
the files with the ``binaryFile`` source (content is never requested, so never
read), and executors open the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CAPTURE_INVENTORY
from .pcap import GLOBAL_HEADER, RECORD_HEADER, CaptureError, _open, read_global_header

def capture_files(spark: SparkSession, path: str, glob: str = "*.pcap") -> DataFrame:
    """``(path, length)`` of every capture file, listed by Spark."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path).select("path", "length"))


def _inventory_rows(it):
    import struct

    import pandas as pd

    for pdf in it:
        out = []
        for path in pdf["path"]:
            row = {"path": path, "byte_order": None, "version": None, "snaplen": None,
                   "link_type": None, "n_packets": 0, "n_bytes": 0, "error": None}
            try:
                with _open(path) as f:
                    head = f.read(GLOBAL_HEADER)
                    if len(head) >= 8:
                        magic = struct.unpack(">I", head[:4])[0]
                        row["byte_order"] = {0xA1B2C3D4: "big", 0xD4C3B2A1: "little"}.get(magic)
                    bo, major, minor, snaplen, link = read_global_header(head)
                    row.update(version=f"{major}.{minor}", snaplen=snaplen, link_type=link)
                    hdr = struct.Struct(bo + "IIiI")
                    while True:
                        h = f.read(RECORD_HEADER)
                        if len(h) < RECORD_HEADER:
                            break
                        incl = hdr.unpack(h)[2]
                        if incl < 0 or incl > snaplen:
                            raise CaptureError(f"record of {incl} bytes, {snaplen} allowed")
                        body = f.read(incl)
                        if len(body) < incl:
                            raise CaptureError("file ends within a record")
                        row["n_packets"] += 1
                        row["n_bytes"] += incl
            except (CaptureError, OSError, struct.error) as e:
                row["error"] = str(e)
            out.append(row)
        yield pd.DataFrame(out, columns=[f.name for f in CAPTURE_INVENTORY.fields])


def capture_inventory(spark: SparkSession, path: str, glob: str = "*.pcap") -> DataFrame:
    """One row per capture file: byte order, version, snaplen, link type,
    packet and byte counts, and the validation error (NULL when valid)."""
    files = capture_files(spark, path, glob).select("path")
    return files.mapInPandas(_inventory_rows, CAPTURE_INVENTORY)

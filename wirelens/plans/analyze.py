"""End-to-end analysis (E1) of one or many captures.

``analyze`` composes the operators lazily:

  raw -> decode -> inspect -> classify      (narrow, one stage)
      -> flow state (ranges of flow, seq)   (one shuffle of pruned rows)
      -> segments (flow, state) ⋈ rules ─┬─> totals, breakdowns, hosts, flows
                                         └─> keys of dropped packets ⋈ raw
                                             -> forwarded / dropped

The report side only needs ``segments`` (about one row per flow), so it
is materialised once - checkpointed to the shared checkpoint folder, which
also cuts the lineage and survives executor loss - and every report table
reads it. Frame bytes never enter the flow-state shuffle; the forwarded and
dropped streams (``keep_data``) take them from ``raw`` again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import report as R
from ..operators.flows import DEFAULT_PIECE_ROWS, with_flow_state
from ..operators.verdicts import packet_hosts, split_packets
from ..session import checkpoint_dir


@dataclass
class Analysis:
    verdicts: DataFrame
    segments: DataFrame
    totals: DataFrame
    apps: DataFrame
    hosts: DataFrame
    flows: DataFrame
    report: DataFrame
    forwarded: DataFrame | None
    dropped: DataFrame | None


def analyze(raw: DataFrame, rules: DataFrame | None = None, mode: str = "packet",
            port_mode: str = "normalized", ip_match: str = "low_endpoint",
            keywords: DataFrame | None = None, keep_data: bool = False,
            materialize: bool = True, piece_rows: int = DEFAULT_PIECE_ROWS,
            processing_time_ms: int | None = None, partitions: int | None = None) -> Analysis:
    """Run the whole pipeline on ``raw_packets`` (any number of captures).

    ``mode`` = ``packet`` (the single-threaded engine's breakdown/hosts) or
    ``flow`` (the multi-threaded engine's). With ``materialize=True`` (the
    default) the segments table is checkpointed to ``spark.checkpoint.dir``
    once, so the report tables read it instead of re-running the scan, and
    a lost executor never forces the packet scan to re-run.

    ``processing_time_ms``: the report's processing time; by default the
    wall time of the materialised run (decode through segments), like the
    reference's timer around its run; pass a number to fix it.
    """
    t0 = time.time()
    hosts = packet_hosts(raw, port_mode=port_mode, keywords=keywords)
    st = with_flow_state(hosts, piece_rows=piece_rows, partitions=partitions)
    checkpoint_dir(st.sparkSession)
    if keep_data and materialize:  # the segments and both streams read the states
        st = st.checkpoint(eager=True)
    seg = R.segments(st)
    if materialize:
        seg = seg.checkpoint(eager=True)
    seg = R.judged(seg, rules, ip_match)
    v = R.packet_verdicts(st, seg)
    if processing_time_ms is None:
        processing_time_ms = int((time.time() - t0) * 1000) if materialize else 0
    totals = R.traffic_totals(seg)
    apps = R.app_breakdown(seg, rules, mode=mode)
    host_list = R.detected_hosts(seg, mode=mode)
    flows = R.flows_from_segments(seg)
    rep = R.traffic_report(totals, apps, host_list, processing_time_ms)
    fwd, drp = split_packets(raw, v) if keep_data else (None, None)
    return Analysis(v, seg, totals, apps, host_list, flows, rep, fwd, drp)

"""IPv4 text <-> integer and flow label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import _col


def ip_format(ip) -> Column:
    """Unsigned 32-bit address (BIGINT) to dotted text ``a.b.c.d``."""
    c = _col(ip).cast("bigint")
    return F.concat_ws(
        ".",
        *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)],
    )


def ip_parse(text) -> Column:
    """Dotted text to unsigned 32-bit BIGINT, lenient like the reference.

    The first four dot-separated parts are read as integers and masked to
    8 bits (so ``256`` becomes 0); parts after the fourth are ignored.
    Fewer than four parts or a non-integer part gives NULL (the reference
    raises; ``ip_parse_error`` says why).
    """
    parts = F.split(_col(text), "\\.", -1)
    octets = [F.element_at(parts, i + 1).try_cast("int") for i in range(4)]
    val = F.lit(0).cast("bigint")
    for o in octets:
        val = F.shiftleft(val, 8) + o.bitwiseAND(255).cast("bigint")
    ok = F.size(parts) >= 4
    for o in octets:
        ok = ok & o.isNotNull()
    return F.when(ok, val)


def ip_parse_error(text) -> Column:
    """Reason ``ip_parse`` returned NULL, else NULL."""
    parts = F.split(_col(text), "\\.", -1)
    bad_part = F.lit(False)
    for i in range(4):
        bad_part = bad_part | F.element_at(parts, i + 1).try_cast("int").isNull()
    return (
        F.when(_col(text).isNull(), F.lit("null address"))
        .when(F.size(parts) < 4, F.lit("fewer than four parts"))
        .when(bad_part, F.lit("non-numeric part"))
    )


def flow_label(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """``a.b.c.d:p <-> e.f.g.h:q proto=n`` for a normalised flow key."""
    return F.format_string(
        "%s:%d <-> %s:%d proto=%d",
        ip_format(src_ip),
        _col(src_port).cast("int"),
        ip_format(dst_ip),
        _col(dst_port).cast("int"),
        _col(protocol).cast("int"),
    )

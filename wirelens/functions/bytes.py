"""Big-endian integer reads and text decoding on BINARY columns.

Every helper returns a Catalyst expression, so packet decoding stays inside
whole-stage codegen; no Python runs per row. Offsets are 0-based Columns
(Spark's ``substring`` is 1-based; the shift happens here). A read past the
end of the buffer yields NULL, which callers guard with explicit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _off(off) -> Column:
    return (off if isinstance(off, Column) else F.lit(off)).cast("int")


def slice_bytes(data, off, n) -> Column:
    """``n`` bytes of ``data`` starting at 0-based ``off`` (BINARY)."""
    return F.substring(_col(data), _off(off) + 1, _off(n))


def uint_be(data, off, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes at ``off`` as BIGINT."""
    return F.conv(F.hex(slice_bytes(data, off, n)), 16, 10).cast("bigint")


def u8(data, off) -> Column:
    return uint_be(data, off, 1)


def u16(data, off) -> Column:
    return uint_be(data, off, 2)


def u32(data, off) -> Column:
    return uint_be(data, off, 4)


def ascii_text(b) -> Column:
    """Decode BINARY as US-ASCII, bytes >= 0x80 becoming U+FFFD.

    ``decode(.., 'US-ASCII')`` raises on such bytes in Spark 4, so the bytes
    are mapped 1:1 through ISO-8859-1 and the high half replaced.
    """
    return F.regexp_replace(F.decode(_col(b), "ISO-8859-1"), "[\\x{80}-\\x{FF}]", "�")


def utf8_text(b) -> Column:
    """Decode BINARY as UTF-8, malformed sequences becoming U+FFFD."""
    return F.make_valid_utf8(_col(b).cast("string"))


def be_hex(v, nbytes: int) -> Column:
    """Hex text of a non-negative integer as ``nbytes`` big-endian bytes."""
    return F.lpad(F.hex(_col(v).cast("bigint")), 2 * nbytes, "0")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound once to ``value``.

    ``element_at(transform(array(value), body), 1)``: the optimizer never
    inlines a lambda variable, so however often ``body`` reads ``v`` (and
    wherever a filter on the result is pushed), ``value`` appears once in
    the plan and is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_columns: dict = {}


def cached_column(name: str, build) -> Column:
    """An expression built once per Spark application and reused.

    Building a large expression costs thousands of Python-to-JVM calls;
    an unresolved Column is independent of any DataFrame, so it is reused.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = (sc.applicationId if sc is not None else None, name)
    col = _columns.get(key)
    if col is None:
        col = _columns[key] = build()
    return col

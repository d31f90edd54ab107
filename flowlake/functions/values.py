"""Typed reading of one decoded field.

A template field carries ``kind`` and ``width`` (see :mod:`flowlake.functions.elements`),
worked out once per template, so that the per-field CASE below stays short.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions import bytes as b

# The abstract data types of the information model, with the way they
# are read and the number of bytes they need at least.
TYPE_KINDS = {
    "unsigned8": ("uint", 1),
    "unsigned16": ("uint", 2),
    "unsigned32": ("uint", 4),
    "unsigned64": ("uint", 8),
    "signed8": ("sint", 1),
    "signed16": ("sint", 2),
    "signed32": ("sint", 4),
    "signed64": ("sint", 8),
    "float32": ("float", 4),
    "float64": ("float", 8),
    "boolean": ("bool", 1),
    "macAddress": ("mac", 6),
    "string": ("text", 0),
    "octetArray": ("bytes", 0),
    "ipv4Address": ("ip", 4),
    "ipv6Address": ("ip", 16),
    "dateTimeSeconds": ("uint", 4),
    "dateTimeMilliseconds": ("uint", 8),
    "dateTimeMicroseconds": ("uint", 8),
    "dateTimeNanoseconds": ("uint", 8),
}


def _signed_text(raw: Column, width: Column) -> Column:
    value = b.digits(raw).cast("decimal(20,0)")
    half = F.try_element_at(F.array(*[F.lit(Decimal(2 ** (8 * n - 1))).cast("decimal(20,0)") for n in range(1, 9)]), F.greatest(width, F.lit(1)))
    number = F.when(value >= half, (value - half - half).cast("decimal(20,0)")).otherwise(value)
    return F.when(width > 0, number).cast("string")


def value_text(raw: Column, kind: Column, width: Column, reduced_size: str = "hex") -> Column:
    """Text form of a field value.

    A value longer than its type is read from its leading bytes. A value shorter than
    its type stays as ``0x…`` (``reduced_size="hex"``) or, for whole numbers, is read as
    a smaller number (``"widen"``).
    """
    if reduced_size not in ("hex", "widen"):
        raise ValueError(f"reduced_size must be 'hex' or 'widen', not {reduced_size!r}")
    short = F.length(raw) < width
    lead = b.cut(raw, 0, width)
    case = F.when(short & ~_widened(kind, raw, reduced_size), b.hex_text(raw))
    return (
        case.when(kind == "uint", b.digits(lead))
        .when(kind == "ip", b.ip_text(raw))
        .when(kind == "text", raw.cast("string"))
        .when(kind == "mac", b.mac_text(raw))
        .when(kind == "sint", _signed_text(lead, F.least(width, F.length(raw))))
        .when(kind == "bool", F.when(b.u8(raw, 0) == 1, F.lit("true")).otherwise(F.lit("false")))
        .when((kind == "float") & (width == 4), b.float32(raw).cast("string"))
        .when(kind == "float", b.float64(raw).cast("string"))
        .otherwise(b.hex_text(raw))
    )


def column_texts(fields: list[tuple[Column, Column, Column]], reduced_size: str = "hex") -> tuple[Column, list[Column]]:
    """``value_text`` of several ``(raw, kind, width)`` of one row, with a small plan.

    Returns an array column of the texts that need the whole CASE, and per field an expression over
    that array (named ``texts``). Whole numbers and IPv4 addresses of full size, the usual cases, are
    null in the array and stay in generated code.
    """
    entries, results = [], []
    for place, (raw, kind, width) in enumerate(fields):
        number = (kind == "uint") & (F.length(raw) >= width)
        address = (kind == "ip") & (width == 4) & (F.length(raw) == 4)
        usual = F.coalesce(raw.isNull() | number | address, F.lit(True))
        entries.append(F.when(~usual, F.struct(raw.alias("raw"), kind.alias("kind"), width.alias("width"))))
        results.append(
            F.when(raw.isNull(), F.lit(None).cast("string"))
            .when(number, b.digits(b.cut(raw, 0, width)))
            .when(address, b.ipv4_text(raw))
            .otherwise(F.get("texts", F.lit(place)))
        )
    texts = F.transform(
        F.array(*entries),
        lambda f: F.when(f.isNotNull(), value_text(f["raw"], f["kind"], f["width"], reduced_size)),
    )
    return texts, results


def _widened(kind: Column, raw: Column, reduced_size: str) -> Column:
    if reduced_size == "hex":
        return F.lit(False)
    return kind.isin("uint", "sint") & (F.length(raw) > 0)


def is_literal(raw: Column, kind: Column, width: Column, reduced_size: str = "hex") -> Column:
    """Whether the value is a JSON number or boolean (else it is a JSON string)."""
    whole = (F.length(raw) >= width) | _widened(kind, raw, reduced_size)
    return kind.isin("uint", "sint", "float", "bool") & whole


def interpret_value(raw: Column, type_name: Column, reduced_size: str = "hex") -> Column:
    """``value_text`` for a column of type names, for use outside of templates."""
    return value_text(raw, kind_of(type_name), width_of(type_name), reduced_size)


def kind_of(type_name: Column) -> Column:
    """How a type is read; anything unknown is bytes."""
    return _lookup(type_name, 0, F.lit("bytes"))


def width_of(type_name: Column) -> Column:
    """The least number of bytes of a type."""
    return _lookup(type_name, 1, F.lit(0))


def _lookup(type_name: Column, position: int, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for name, row in TYPE_KINDS.items() for x in (name, row[position])])
    return F.coalesce(F.try_element_at(table, type_name), default)

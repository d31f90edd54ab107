"""Column helpers for big-endian binary layouts.

Offsets count from 0 and may be Python ints or Columns. ``substring`` on a BINARY
column copies only the wanted bytes, so a read costs the same at any offset, and all
of these expressions have generated code (no Python, no lambda).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions.columns import either

Offset = "int | Column"


def _start(offset) -> Column:
    return F.lit(offset + 1) if isinstance(offset, int) else offset + F.lit(1)


def _length(n) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def cut(buf: Column, offset, n) -> Column:
    """``n`` bytes from ``offset`` (fewer where the buffer ends)."""
    return F.substring(buf, _start(offset), _length(n))


def digits(buf: Column) -> Column:
    """Decimal text of up to 8 bytes read as one unsigned number."""
    return F.conv(F.hex(buf), 16, 10)


def u8(buf: Column, offset) -> Column:
    return digits(cut(buf, offset, 1)).cast("int")


def u16(buf: Column, offset) -> Column:
    return digits(cut(buf, offset, 2)).cast("int")


def u24(buf: Column, offset) -> Column:
    return digits(cut(buf, offset, 3)).cast("int")


def u32(buf: Column, offset) -> Column:
    return digits(cut(buf, offset, 4)).cast("bigint")


def u64(buf: Column, offset) -> Column:
    """Full unsigned range, hence a decimal."""
    return digits(cut(buf, offset, 8)).cast("decimal(20,0)")


def word(buf: Column, offset) -> Column:
    """Eight bytes as one number, to be read once and cut with :func:`bits`."""
    return F.conv(F.hex(cut(buf, offset, 8)), 16, -10).cast("bigint")


def bits(value: Column, after: int, n: int, type_name: str = "int") -> Column:
    """The ``n`` bits of a word that ``after`` bits follow."""
    return F.shiftrightunsigned(value, after).bitwiseAND(F.lit(2**n - 1)).cast(type_name)


def signed(value: Column, bits: int) -> Column:
    """Two's complement reading of an unsigned value."""
    number = value.cast("decimal(20,0)")
    return F.when(number >= F.lit(2 ** (bits - 1)), number - F.lit(2**bits)).otherwise(number).cast("bigint")


def pack(value: Column, n: int) -> Column:
    """The low ``n`` bytes of a number, big-endian."""
    text = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.right(text, F.lit(2 * n)))


def hex_text(buf: Column) -> Column:
    """``0x`` and lower-case digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(buf)))


def ipv4_number_text(number: Column) -> Column:
    """Dotted text of a 32-bit number."""
    return F.concat_ws(
        ".",
        F.shiftright(number, 24).bitwiseAND(F.lit(255)).cast("string"),
        F.shiftright(number, 16).bitwiseAND(F.lit(255)).cast("string"),
        F.shiftright(number, 8).bitwiseAND(F.lit(255)).cast("string"),
        number.bitwiseAND(F.lit(255)).cast("string"),
    )


def ipv4_text(buf: Column, offset=0) -> Column:
    return ipv4_number_text(u32(buf, offset))


def _ipv6_groups(buf: Column, offset) -> Column:
    return F.concat_ws(
        ":",
        *[F.lower(F.conv(F.hex(cut(buf, offset + 2 * i, 2)), 16, 16)) for i in range(8)],
    )


def _compress(groups: Column) -> Column:
    """Replace the longest, leftmost run of two or more zero groups by ``::``."""
    padded = F.concat(F.lit(":"), groups, F.lit(":"))
    result = groups
    for n in range(2, 9):
        run = ":" + "0:" * n
        at = F.locate(run, padded)
        head = F.ltrim(F.substring(padded, F.lit(1), at - F.lit(1)), F.lit(":"))
        tail = F.rtrim(F.substring(padded, at + F.lit(len(run)), F.lit(64)), F.lit(":"))
        text = F.concat(head, F.lit("::"), tail)
        result = either(at > 0, text, result)
    return result


def ipv6_text(buf: Column, offset=0) -> Column:
    """Canonical text: lower case, ``::`` for the longest zero run, dotted form for IPv4-mapped."""
    mapped = F.hex(cut(buf, offset, 12)) == F.lit("0" * 20 + "FFFF")
    # the one-element transform names the group text, so that its many uses below share one evaluation
    text = F.element_at(F.transform(F.array(_ipv6_groups(buf, offset)), _compress), 1)
    return either(mapped, ipv4_text(buf, offset + 12), text)


def ip_text(buf: Column) -> Column:
    """Text of a 4- or 16-byte address; any other length is ``?`` and hex digits."""
    other = F.concat(F.lit("?"), F.lower(F.hex(buf)))
    return either(F.length(buf) == 4, ipv4_text(buf), either(F.length(buf) == 16, ipv6_text(buf), other))


def mac_text(buf: Column) -> Column:
    """``aa:bb:…`` for any number of bytes."""
    return F.lower(F.regexp_replace(F.hex(buf), "(..)(?=.)", "$1:"))


def mac_at(digits_: Column, i: int) -> Column:
    """Address ``i`` of a text of hex digits, 12 for each."""
    return F.concat_ws(":", *[F.substring(digits_, 12 * i + 2 * k + 1, 2) for k in range(6)])


def float32(buf: Column, offset=0) -> Column:
    """IEEE 754 single precision from its bits."""
    bits = u32(buf, offset)
    sign = F.when(F.shiftright(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(0xFF))
    fraction = bits.bitwiseAND(F.lit(0x7FFFFF)) / F.lit(float(2**23))
    return _ieee(sign, exponent, fraction, bias=127, top=0xFF).cast("float")


def float64(buf: Column, offset=0) -> Column:
    """IEEE 754 double precision from its bits."""
    high, low = u32(buf, offset), u32(buf, offset + 4)
    sign = F.when(F.shiftright(high, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    mantissa = high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(2**32) + low
    return _ieee(sign, exponent, mantissa / F.lit(float(2**52)), bias=1023, top=0x7FF)


def _ieee(sign: Column, exponent: Column, fraction: Column, bias: int, top: int) -> Column:
    return (
        F.when((exponent == top) & (fraction > 0), F.lit(float("nan")))
        .when(exponent == top, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * fraction * F.lit(2.0 ** (1 - bias)))
        .otherwise(sign * (F.lit(1.0) + fraction) * F.pow(F.lit(2.0), exponent - F.lit(bias)))
    )

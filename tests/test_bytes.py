"""Byte helpers and typed values against Python's own reading."""

import ipaddress
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlake.functions import bytes as b
from flowlake.functions.values import interpret_value, is_literal, kind_of, width_of


def one(spark, rows, *columns):
    frame = spark.createDataFrame([(bytearray(r),) for r in rows], "raw binary")
    return [tuple(row) for row in frame.select(*columns).collect()]


def test_ipv6_text(spark):
    texts = [
        "::", "::1", "1::", "2001:db8::1", "2001:db8:0:1:1:1:1:1", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "fe80::1:0:0:1",
        "0:1:2:3:4:5:6:7", "1:2:3:4:5:6:0:0", "::ffff:10.1.2.3", "a:b:c:d:e:f:0:1", "1:2:3:4:5:6:7:0", "1:0:2:0:3:0:4:0",
    ]
    raw = [ipaddress.IPv6Address(t).packed for t in texts]
    got = one(spark, raw, b.ipv6_text(F.col("raw")))
    assert [g[0] for g in got] == ["10.1.2.3" if "ffff:10" in t else str(ipaddress.IPv6Address(t)) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 1, 0xABCD]), min_size=8, max_size=8), min_size=20, max_size=40))
def test_ipv6_text_any(spark, groups):
    raw = [struct.pack(">8H", *g) for g in groups if g[:5] != [0] * 5]
    if raw:
        got = one(spark, raw, b.ipv6_text(F.col("raw")))
        assert [g[0] for g in got] == [str(ipaddress.IPv6Address(r)) for r in raw]


def test_numbers(spark):
    raw = bytes([0xFF] * 8)
    row = one(spark, [raw], b.u8(F.col("raw"), 0), b.u16(F.col("raw"), 1), b.u24(F.col("raw"), 2), b.u32(F.col("raw"), 3), b.u64(F.col("raw"), 0))[0]
    assert [int(x) for x in row] == [255, 65535, 16777215, 4294967295, 18446744073709551615]


def test_floats(spark):
    values = [0.0, 1.5, -2.25, 3.0e38, 1.0e-40, float("inf")]
    got = one(spark, [struct.pack(">f", v) for v in values], b.float32(F.col("raw")))
    assert [struct.pack(">f", g[0]) for g in got] == [struct.pack(">f", v) for v in values]
    doubles = [0.1, -1.0e300, 5e-324, 123456.789, float("-inf")]
    got = one(spark, [struct.pack(">d", v) for v in doubles], b.float64(F.col("raw")))
    assert [g[0] for g in got] == doubles


def test_typed_values(spark):
    cases = [
        ("unsigned64", b"\xff" * 8, "18446744073709551615", True),
        ("unsigned64", b"\x00\x00\x00\x50", "0x00000050", False),
        ("unsigned16", b"\x10", "0x10", False),
        ("unsigned8", b"\x07\x09", "7", True),
        ("signed32", b"\xff\xff\xff\xfe", "-2", True),
        ("signed64", b"\x80" + b"\x00" * 7, "-9223372036854775808", True),
        ("signed8", b"\x80", "-128", True),
        ("boolean", b"\x01", "true", True),
        ("boolean", b"\x02", "false", True),
        ("macAddress", b"\x00\x1a\x02\xff\x10\x01", "00:1a:02:ff:10:01", False),
        ("string", b"xe-0/0/1", "xe-0/0/1", False),
        ("ipv4Address", b"\x0a\x00\x00\x0e", "10.0.0.14", False),
        ("ipv4Address", b"\x0a\x00", "0x0a00", False),
        ("ipv6Address", b"\x20\x01" + b"\x00" * 13 + b"\x01", "2001::1", False),
        ("octetArray", b"\x01\x02", "0x0102", False),
        ("basicList", b"\x01", "0x01", False),
        ("float64", struct.pack(">d", 1.5), "1.5", True),
        ("dateTimeMilliseconds", (1483484581770).to_bytes(8, "big"), "1483484581770", True),
    ]
    frame = spark.createDataFrame([(t, bytearray(r), i) for i, (t, r, _, _) in enumerate(cases)], "t string, raw binary, i int")
    kind, width = kind_of(F.col("t")), width_of(F.col("t"))
    rows = frame.select("i", interpret_value(F.col("raw"), F.col("t")), is_literal(F.col("raw"), kind, width)).orderBy("i").collect()
    assert [(r[1], r[2]) for r in rows] == [(v, n) for _, _, v, n in cases]
    wide = frame.orderBy("i").select(interpret_value(F.col("raw"), F.col("t"), "widen")).collect()
    assert [wide[1][0], wide[2][0]] == ["80", "16"]

"""sFlow datagrams are read by whole Arrow batches, and every text is made once."""

import ipaddress
import random
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_datagrams import ETHERNET, IPV4, RECORD, T256, UDP, datagrams, flow_sample, fset, ipfix, plan, raw_header, sflow, tagged

from flowlake.functions import sampled_messages as read
from flowlake.functions.sampled import Datagrams
from flowlake.operators import ipfix as ix
from flowlake.operators import messages as m
from flowlake.operators import sflow as sf
from flowlake.operators import sflow_messages as sm
from flowlake.plans import catalog
from flowlake.plans import fixtures as fx
from flowlake.sources.elements import default_elements


def test_walks_take_no_fold(spark):
    frame = datagrams(spark, [sflow(flow_sample(raw_header(ETHERNET + IPV4 + UDP)))], "sflow")
    for job in (sf.sflow_samples(frame), sf.sflow_packet_table(frame), sf.sflow_counter_table(frame, "vg"), sm.sflow_messages(frame)):
        text = plan(job)
        assert "aggregate(" not in text and text.count("ArrowEvalPython") == 1


def test_message_text_is_made_once(spark):
    """A filter on the text, which parsing adds, has the message assembled no second time."""
    frame = datagrams(spark, [sflow(flow_sample(raw_header(ETHERNET + IPV4 + UDP)))], "sflow")
    lines = m.encode_struct(sm.sflow_messages(frame).drop("recv_ts"), sm.MESSAGE)
    parsed = m.parse_messages(lines, "sflow")
    assert plan(parsed).count("StructsToJsonEvaluator") == 1
    assert parsed.first().Samples[0].Records.RawHeader.L3.TTL == 62


def test_long_lists(spark):
    """Of 700 unknown samples the walk keeps none; as many as a datagram holds are walked, whatever it announces."""
    packet = flow_sample(raw_header(ETHERNET + IPV4 + UDP))
    empty = sflow(*[tagged(9, b"")] * 700, packet)
    many = sflow(packet)
    many = many[:24] + struct.pack(">I", 2**32 - 1) + many[28:]
    frame = datagrams(spark, [empty, many, sflow(*[packet] * 60)], "sflow")
    assert {r.msg_id: r["count"] for r in sf.sflow_samples(frame).groupBy("msg_id").count().collect()} == {0: 1, 2: 60}
    assert [(r.msg_id, r.reason) for r in sf.sflow_rejects(frame).collect()] == [(1, "cut short")]


def test_batches_that_are_slices():
    payload = pa.array([b"xxx", sflow(flow_sample(raw_header(ETHERNET + IPV4 + UDP))), sflow()], pa.binary())[1:]
    found = Datagrams(payload, pa.array([12, 12], pa.int32()), pa.array([1, 0], pa.int64()), [1, 2], sf.COUNTER_BYTES).checked().to_pylist()
    assert [(r["error"], len(r["samples"])) for r in found] == [(None, 1), (None, 0)]
    none = Datagrams(payload[:0], pa.array([], pa.int32()), pa.array([], pa.int64()), [1, 2], sf.COUNTER_BYTES)
    assert len(none.checked()) == 0 and len(read.read_messages(none, {}, False)) == 0


def test_address_texts():
    rnd = random.Random(3)
    sixteen = [b"".join(rnd.choice([b"\0\0", b"\0\0", b"\0\1", rnd.randbytes(2)]) for _ in range(8)) for _ in range(500)] + [bytes(16)]
    octets = np.frombuffer(b"".join(sixteen), np.uint8).reshape(-1, 16)
    assert read.ipv6_texts(octets).to_pylist() == [str(ipaddress.IPv6Address(x)) for x in sixteen]
    mapped = np.frombuffer(bytes(10) + b"\xff\xff\x0a\x00\xc8\x07", np.uint8).reshape(1, 16)
    assert read.ipv6_texts(mapped).to_pylist() == ["10.0.200.7"]
    assert read.ipv4_texts(octets[:, 12:]).to_pylist() == [str(ipaddress.IPv4Address(x[12:])) for x in sixteen]
    assert read.mac_texts(octets[:, :6]).to_pylist() == [x[:6].hex(":") for x in sixteen]


def test_words_of_absent_counters_are_not_made(spark, tmp_path):
    """Words of a kind that a sample lacks are no rows that a filter takes out again."""
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50).write.parquet(str(tmp_path / "lineitem.parquet"))
    frame = catalog.QUERIES["parse_sflow_messages"](spark, str(tmp_path))
    assert plan(frame).count("if (isnotnull(c") >= len(sf.COUNTERS) and frame.count() > 50


def test_words_are_packed_by_eights(spark):
    row = spark.range(1).selectExpr("-2 AS a", "70000 AS b", "CAST(NULL AS INT) AS c")
    parts = [("a", 1), ("b", 2), ("a", 4), ("b", 1), ("a", 8), ("b", 3)]
    expected = bytes.fromhex("fe" "1170" "fffffffe" "70" "fffffffffffffffe" "011170")
    assert fx._words(*parts).count("hex(") - fx._words(*parts).count("unhex(") == 3
    got = row.select(F.expr(fx._words(*parts)).alias("x"), F.expr(fx._words(("a", 2), ("c", 2))).alias("y")).first()
    assert (bytes(got.x), got.y) == (expected, None)


def test_fields_do_not_move(spark):
    """Messages are assembled and their fields counted where the records came together: one exchange, by message."""
    frame = datagrams(spark, [ipfix(fset(2, T256)), ipfix(fset(256, RECORD)), ipfix(fset(256, RECORD * 2))])
    counted = catalog._through_json(ix.ipfix_table(frame, default_elements(spark), on_error="keep_sets"), "ipfix")
    moved = [line for line in plan(counted).splitlines() if "Exchange hashpartitioning" in line and "msg_id" in line]
    assert len(moved) == 1 and "hashpartitioning(msg_id" in moved[0]
    found = {(r.msg_id, r.element_id, r.value): r.n for r in counted.collect()}
    assert found == {(1, 8, "10.0.0.14"): 1, (1, 7, "2380"): 1, (2, 8, "10.0.0.14"): 2, (2, 7, "2380"): 2}


def test_json_text_of_fields(spark):
    """Usual fields are written without a JSON value in between, with the text that it would have."""
    field = "struct<I:int,V:string,E:bigint,num:boolean>"
    odd = [(1, "5\n", None, True), (1, 'a"b\\c', 0, False), (2, "ü\u0001", 9, False), (3, None, 9, False), (None, "x", None, False),
           (4, "true", None, True), (4, "-0", None, True), (4, "18446744073709551615", 0, True), (5, "7", 29305, None), (6, "", None, False)]
    rows = spark.createDataFrame(
        [(0, "a", (1,), [odd, [], None]), (1, "a", None, None), (2, None, None, []), (3, None, None, None), (4, None, (None,), [odd[:1] + [None]])],
        f"i int, AgentID string, Header struct<x:int>, DataSets array<array<{field}>>",
    )
    plain = rows.select("i", F.to_json(F.struct("AgentID", "Header", F.transform("DataSets", lambda r: F.transform(r, lambda f: F.struct(
        f["I"].alias("I"), m._json_value(f).alias("V"), m._enterprise(f).alias("E")))).alias("DataSets"))).alias("value"))
    assert m.encode_message(rows).orderBy("i").collect() == plain.orderBy("i").collect()
    usual = rows.where("i = 0").selectExpr("i", "AgentID", "Header", "array(array(DataSets[0][8], DataSets[0][9])) AS DataSets")
    assert m.encode_message(usual).first().value == '{"AgentID":"a","Header":{"x":1},"DataSets":[[{"I":5,"V":"7","E":29305},{"I":6,"V":""}]]}'
    assert "rlike" in plan(m.encode_message(usual)).lower() and "array_join" in plan(m.encode_message(usual))

"""Hand-made datagrams: framing, templates, rejects, sFlow samples, packets."""

import datetime as dt
import struct
import time

import pytest
from pyspark.sql import functions as F

from flowlake.operators import ipfix as ix
from flowlake.operators import messages as m
from flowlake.operators import netflow5 as n5
from flowlake.operators import netflow9 as n9
from flowlake.operators import packet
from flowlake.operators import sflow as sf
from flowlake.operators import templates as t
from flowlake.session import stored
from flowlake.sources import sinks
from flowlake.sources.datagrams import DATAGRAM_SCHEMA, read_datagrams, route_by_version
from flowlake.sources.elements import default_elements, load_elements
from flowlake.streaming import jobs
from flowlake.streaming.templates_state import stream_resolve_templates

BASE = dt.datetime(2024, 1, 1)


def datagrams(spark, payloads, proto="ipfix", agent="10.0.0.1"):
    rows = [(agent, proto, BASE + dt.timedelta(seconds=i), i, bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, DATAGRAM_SCHEMA)


def fset(set_id, body):
    return struct.pack(">HH", set_id, len(body) + 4) + body


def ipfix(*sets):
    body = b"".join(sets)
    return struct.pack(">HHIII", 10, 16 + len(body), 1700000000, 1, 7) + body


def v9(*sets):
    return struct.pack(">HHIIII", 9, 1, 1000, 1700000000, 1, 7) + b"".join(sets)


def template(tid, *fields):
    out = struct.pack(">HH", tid, len(fields))
    for field in fields:
        out += struct.pack(">HH", *field[:2]) + (struct.pack(">I", field[2]) if len(field) > 2 else b"")
    return out


T256 = template(256, (8, 4), (7, 2))
RECORD = bytes([10, 0, 0, 14]) + struct.pack(">H", 2380)


def values(table):
    rows = m.explode_fields(table).orderBy("msg_id", "set_ix", "record_ix", "field_ix").collect()
    return [(r.msg_id, r.element_id, r.value) for r in rows]


def test_empty_payload_is_rejected(spark):
    good, rejects = route_by_version(datagrams(spark, [b"", b"\x00\x0a\x00\x10", b"\x00\x05\x00\x10"]))
    assert good.count() == 1
    assert sorted(r.reason for r in rejects.collect()) == ["short header", "wrong version"]
    assert n5.netflow5_table(datagrams(spark, [b""])).count() == 0
    assert sf.sflow_rejects(datagrams(spark, [b""], "sflow")).first().reason == "short header"


def test_several_sets_in_one_message(spark):
    """More sets than the unrolled walk reads; templates come before their data."""
    sets = [fset(2, template(300 + i, (8, 4), (7, 2))) for i in range(6)]
    options = fset(3, struct.pack(">HHH", 512, 2, 1) + struct.pack(">HHHH", 149, 4, 41, 8))
    message = ipfix(*sets, options, fset(2, T256 + template(257, (1, 4))), fset(256, RECORD * 2), fset(305, RECORD + b"\x00\x00\x00"))
    frame = datagrams(spark, [message])
    assert ix.ipfix_sets(frame).count() == 10
    seen = ix.template_table(frame)
    ids = [r.template_id for r in t.known_template_ids(t.template_registry(seen)).collect()]
    assert ids == [256, 257, 300, 301, 302, 303, 304, 305, 512]
    assert seen.where("is_option").first().scope_count == 1
    table = ix.ipfix_table(frame, default_elements(spark))
    assert table.count() == 3
    assert values(table)[:2] == [(0, 8, "10.0.0.14"), (0, 7, "2380")]


def test_unknown_template_is_reported(spark):
    frame = datagrams(spark, [ipfix(fset(256, RECORD), fset(257, RECORD))])
    assert ix.ipfix_table(frame, default_elements(spark)).count() == 0
    report = ix.ipfix_report(frame, default_elements(spark)).collect()
    assert sorted((r.set_id, r.reason, r.n) for r in report) == [(256, "unknown template", 1), (257, "unknown template", 1)]


def test_template_changes_apply_from_their_position_on(spark):
    other = template(256, (7, 2), (8, 4))
    frame = datagrams(spark, [
        ipfix(fset(256, RECORD)), ipfix(fset(2, T256)), ipfix(fset(256, RECORD)), ipfix(fset(2, T256)),
        ipfix(fset(2, other), fset(256, RECORD[4:] + RECORD[:4])), ipfix(fset(256, RECORD[4:] + RECORD[:4])),
    ])
    table = ix.ipfix_table(frame, default_elements(spark))
    assert values(table) == [
        (2, 8, "10.0.0.14"), (2, 7, "2380"), (4, 7, "2380"), (4, 8, "10.0.0.14"), (5, 7, "2380"), (5, 8, "10.0.0.14"),
    ]
    # the repeated announcement is not a change
    assert t.template_versions(ix.template_table(frame)).count() == 2


def test_registry_survives_a_restart(spark, tmp_path):
    first = datagrams(spark, [ipfix(fset(2, T256))])
    sinks.save_templates(t.template_registry(ix.template_table(first)), str(tmp_path / "r"))
    later = datagrams(spark, [b"", ipfix(fset(256, RECORD))])
    registry = sinks.load_templates(spark, str(tmp_path / "r"))
    assert ix.ipfix_table(later, default_elements(spark), registry).count() == 1
    assert sinks.load_templates(spark, str(tmp_path / "nothing")).count() == 0


def test_broken_sets(spark):
    """IPFIX drops the message, v9 keeps what came before."""
    partial = RECORD * 2 + RECORD[:5]
    messages = [
        ipfix(fset(2, T256)), ipfix(fset(256, RECORD), fset(256, partial)), ipfix(fset(256, RECORD), struct.pack(">HH", 256, 2) + b"\x00\x00"),
        ipfix(fset(256, RECORD), fset(0, RECORD)), ipfix(fset(256, RECORD), fset(2, template(300, (8, 4), (7, 2))[:8])),
        ipfix(fset(256, RECORD), fset(100, RECORD)),
    ]
    frame = datagrams(spark, messages)
    table = ix.ipfix_table(frame, default_elements(spark))
    assert sorted({r.msg_id for r in table.collect()}) == [5]
    kept = ix.ipfix_table(frame, default_elements(spark), on_error="keep_sets")
    assert sorted(r.msg_id for r in kept.collect()) == [1, 5]
    nine = datagrams(spark, [v9(fset(0, T256)), v9(fset(256, RECORD), fset(256, partial), fset(256, RECORD))], "netflowv9")
    assert n9.netflow9_table(nine, default_elements(spark)).count() == 3


def test_unknown_and_enterprise_elements(spark):
    odd = template(256, (8, 4), (0x8000 | 77, 2, 9999))
    frame = datagrams(spark, [ipfix(fset(2, odd), fset(256, RECORD))])
    assert ix.ipfix_table(frame, default_elements(spark)).count() == 0
    assert ix.ipfix_report(frame, default_elements(spark)).first().reason == "unknown element"
    extra = spark.createDataFrame([(9999, 77, "vendorPort", "unsigned16")], default_elements(spark).schema)
    table = ix.ipfix_table(frame, default_elements(spark).unionByName(extra))
    assert values(table)[1] == (0, 77, "2380")


def test_variable_length_values(spark):
    shape = template(256, (82, 65535), (7, 2))
    long_name = b"x" * 300
    body = b"\x03abc" + struct.pack(">H", 1) + b"\xff" + struct.pack(">H", 300) + long_name + struct.pack(">H", 2)
    table = ix.ipfix_table(datagrams(spark, [ipfix(fset(2, shape), fset(256, body))]), default_elements(spark))
    assert [v for _, _, v in values(table)] == ["abc", "1", "x" * 300, "2"]


def test_element_dictionary_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"0": {"1": ["octets", "unsigned64"], "2": ["broken"]}, "9": {"5": ["own", "string"]}}')
    replaced = load_elements(spark, str(tmp_path / "e.json"))
    assert sorted((r.enterprise, r.element_id, r.name) for r in replaced.collect()) == [(0, 1, "octets"), (9, 5, "own")]
    merged = load_elements(spark, str(tmp_path / "e.json"), mode="merge")
    assert merged.count() == default_elements(spark).count() + 1
    (tmp_path / "e.csv").write_text("ElementID,Name,Abstract Data Type\n1,octetDeltaCount,unsigned64\n5-6,,\n")
    assert load_elements(spark, str(tmp_path / "e.csv")).count() == 1


def v5(count, records):
    return struct.pack(">HHIIIIBBH", 5, count, 5000, 1700000000, 0, 9, 0, 0, 0) + b"".join(records)


def test_netflow5_bounds(spark):
    record = bytes(range(48))
    packets = [v5(29, [record] * 29 + [b"\x00" * 6]), v5(0, []), v5(31, [record] * 31), v5(2, [record])]
    frame = datagrams(spark, packets, "netflowv5")
    assert n5.netflow5_table(frame).count() == 29
    assert sorted(r.reason for r in n5.netflow5_rejects(frame).collect()) == ["count out of bounds", "count out of bounds", "short body"]


# ------------------------------------------------------------------ sFlow and packets

ETHERNET = bytes.fromhex("f4a73944a82758 00bbe7576f".replace(" ", "")) + b"\x08\x00"
IPV4 = bytes.fromhex("45b80046002040003e118565c0a80a010a000002")
UDP = struct.pack(">HHHH", 41836, 53, 50, 0)
TCP = struct.pack(">HHIIHHI", 443, 56521, 1, 2, 0x5110, 1024, 0)


def tagged(tag, body, pad=b""):
    return struct.pack(">II", tag, len(body) + len(pad)) + body + pad


def raw_header(data, protocol=1, size=None):
    body = struct.pack(">IIII", protocol, 1400, 4, len(data) if size is None else size) + data
    return tagged(1, body + b"\x00" * (-len(data) % 4))


def flow_sample(*records, pad=b""):
    head = struct.pack(">IIIIIIII", 7, 0, 4096, 100, 0, 536, 728, len(records))
    return tagged(1, head + b"".join(records), pad)


def sflow(*samples):
    return struct.pack(">II4sIIII", 5, 1, bytes([192, 168, 10, 0]), 5, 37591, 1000, len(samples)) + b"".join(samples)


def test_sflow_samples(spark):
    packet_bytes = ETHERNET + IPV4 + UDP
    counters = tagged(2, struct.pack(">IIII", 1, 0x01000005, 1, 0)[:12] + tagged(5, struct.pack(">IQIIII", 1, 2**63 + 5, 3, 4, 5, 6)))
    message = sflow(*[flow_sample(raw_header(packet_bytes)) for _ in range(4)], counters)
    padded = sflow(flow_sample(raw_header(packet_bytes), pad=b"\x00" * 8), flow_sample(raw_header(packet_bytes)), tagged(99, b"\x00" * 4))
    frame = datagrams(spark, [message, padded], "sflow")
    assert sf.sflow_samples(frame).groupBy("msg_id").count().orderBy("msg_id").collect() == [(0, 5), (1, 2)]
    assert sf.sflow_samples(frame, exclude_types=[2]).where("msg_id = 0").count() == 4
    row = sf.sflow_packet_table(frame).first()
    assert (row.l2.SrcMAC, row.l2.DstMAC) == ("58:00:bb:e7:57:6f", "f4:a7:39:44:a8:27")
    assert (row.l3_v4.TTL, row.l3_v4.Protocol, row.l4_udp.SrcPort, row.l4_udp.DstPort) == (62, 17, 41836, 53)
    counter = sf.sflow_counter_table(frame, "vlan").first()
    assert (int(counter.Octets), counter.SourceIDType, counter.SourceIDIdx) == (2**63 + 5, 1, 5)


def test_one_bad_sample_spoils_the_datagram(spark):
    arp = ETHERNET[:12] + b"\x08\x06" + b"\x00" * 28
    good = flow_sample(raw_header(ETHERNET + IPV4 + UDP))
    private = struct.pack(">II", (1 << 12) | 1, 4) + b"\x00" * 4
    messages = [
        sflow(good, flow_sample(raw_header(arp))), sflow(good, flow_sample(raw_header(b"\x00" * 60, size=1504))),
        sflow(good, private), sflow(good)[:-10], sflow(good),
    ]
    frame = datagrams(spark, messages, "sflow")
    assert [r.msg_id for r in sf.sflow_packet_table(frame).collect()] == [4]
    reasons = {r.msg_id: r.reason for r in sf.sflow_rejects(frame).collect()}
    assert reasons == {
        0: "unknown ether type", 1: "sampled header over 1500 bytes", 2: "not a standard sample", 3: "length past the end",
    }
    kept = sf.sflow_packet_table(frame, on_error="keep_samples")
    assert sorted(r.msg_id for r in kept.collect()) == [0, 1, 2, 4]


def test_packet_layers(spark):
    six = bytes.fromhex("6000000000083a40") + b"\xfe\x80" + b"\x00" * 13 + b"\x01" + b"\xff\x02" + b"\x00" * 13 + b"\x01"
    tcp4 = IPV4[:9] + b"\x06" + IPV4[10:]
    rows = [
        (0, 1, ETHERNET + tcp4 + TCP), (1, 11, tcp4 + TCP), (2, 12, six + b"\x80\x00\x00\x00\x01\x02\x03\x04"), (3, 7, IPV4),
        (4, 11, IPV4[:10]), (5, 1, ETHERNET[:12] + b"\x81\x00\x20\x05" + b"\x08\x00" + tcp4 + TCP),
    ]
    frame = spark.createDataFrame([(i, p, bytearray(h)) for i, p, h in rows], "i int, protocol int, header binary")
    got = {r.i: r for r in packet.packet_layers(frame).collect()}
    assert (got[0].l4_tcp.Flags, got[0].l4_tcp.DataOffset) == (272, 5)
    assert got[1].l2 is None and got[1].l4_tcp.DstPort == 56521
    assert (got[2].l3_v6.Src, got[2].l4_icmp.Type, bytes(got[2].l4_icmp.RestHeader)) == ("fe80::1", 128, b"\x01\x02\x03\x04")
    assert got[3].packet_error == "unknown header protocol" and got[4].packet_error == "short IPv4 header"
    assert (got[5].l2.Vlan, got[5].l2.vlan_id, got[5].l2.EtherType) == (8197, 5, 2048)


# ------------------------------------------------------------------ state and plans


def test_waiting_sets_come_out_with_a_later_template(spark, tmp_path):
    import time

    for i, message in enumerate([ipfix(fset(256, RECORD)), ipfix(fset(2, T256)), ipfix(fset(256, RECORD))]):
        datagrams(spark, [b""] * i + [message]).where("length(payload) > 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = read_datagrams(spark, str(tmp_path / "in"), stream=True, maxFilesPerTrigger=1)
    resolved = stream_resolve_templates(stream, slots=1)
    run = jobs.start(resolved, str(tmp_path / "c"), "1 second", path=str(tmp_path / "out"))
    deadline, rows = time.time() + 60, []
    while time.time() < deadline and len(rows) < 2:
        time.sleep(2)
        rows = spark.read.schema(resolved.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
    run.stop()
    assert sorted(r.msg_id for r in rows) == [0, 2]
    assert all(len(r.fields) == 2 for r in rows)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_narrow_jobs_do_not_shuffle(spark, tmp_path):
    path = str(tmp_path / "d")
    datagrams(spark, [b""], "sflow").write.parquet(path)
    frame = read_datagrams(spark, path)
    for job in (n5.netflow5_table(frame), sf.sflow_packet_table(frame), sf.sflow_counter_table(frame, "generic"), ix.template_table(frame)):
        assert "Exchange" not in plan(job)
    assert "PushedFilters: [IsNotNull(proto), EqualTo(proto,sflow)]" in plan(frame.where(F.col("proto") == "sflow"))


def test_small_registry_is_broadcast(spark):
    """With a registry table only, sets do not move for the template lookup."""
    frame = datagrams(spark, [ipfix(fset(2, T256), fset(256, RECORD))])
    table = ix.ipfix_table(frame, default_elements(spark), on_error="keep_sets")
    table.collect()
    assert "BroadcastHashJoin" in plan(table)


@pytest.mark.parametrize("job", [ix.ipfix_table, ix.ipfix_flow_rows])
def test_set_bytes_do_not_move(spark, job):
    """The decoding plan has no exchange but broadcasts: versions, field lists and broken messages go to the sets."""
    frame = datagrams(spark, [ipfix(fset(2, T256)), ipfix(fset(256, RECORD)), ipfix(fset(256, RECORD), fset(256, RECORD[:5]))])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(job(stored(frame), default_elements(spark)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert len(moved) <= 2 and not any("payload" in line or "body" in line for line in moved)
    assert "SortMergeJoin" not in text and "Window" not in text


def test_flapping_template(spark):
    """An agent that alternates between two templates 32,000 times: sets meet the versions of their slot only."""
    two = [T256, template(256, (7, 2), (8, 4))]
    n = 32_000
    half = {k: [bytes(ipfix(fset(2, two[k]))), bytes(ipfix(fset(256, RECORD if k == 0 else RECORD[4:] + RECORD[:4])))] for k in (0, 1)}
    rows = spark.range(2 * n).selectExpr(
        "'10.0.0.1' AS agent", "'ipfix' AS proto", "timestamp_millis(id div 2 * 37) AS recv_ts", "id AS msg_id",
        *[f"CASE id % 4 WHEN 0 THEN X'{half[0][0].hex()}' WHEN 1 THEN X'{half[0][1].hex()}' WHEN 2 THEN X'{half[1][0].hex()}' ELSE X'{half[1][1].hex()}' END AS payload"],
    )
    began = time.time()
    versions = stored(t.template_versions(ix.template_table(rows)))
    spans, slotted = t.version_slots(versions)
    per_slot = slotted.groupBy("slot").count().agg({"count": "max"}).first()[0]
    assert versions.count() == n and spans.first().slots > n / 5 and per_slot <= 3 * t.SLOT
    found = ix.ipfix_table(rows, default_elements(spark)).selectExpr("size(fields) AS n", "fields[0].V AS v", "msg_id")
    good = found.where("n = 2").selectExpr("count(*) AS n", "count_if(v = IF(msg_id % 4 = 1, '10.0.0.14', '2380')) AS same").first()
    assert good.n == good.same == n and time.time() - began < 60


def test_versions_at_one_time_go_by_message_number(spark):
    two = [T256, template(256, (7, 2), (8, 4))]
    messages = [m for k in range(60) for m in (ipfix(fset(2, two[k % 2])), ipfix(fset(256, RECORD if k % 2 == 0 else RECORD[4:] + RECORD[:4])))]
    frame = datagrams(spark, messages).withColumn("recv_ts", F.lit("2024-01-01").cast("timestamp"))
    rows = ix.ipfix_table(frame, default_elements(spark)).collect()
    assert len(rows) == 60 and {next(f.V for f in r.fields if f.I == 8) for r in rows} == {"10.0.0.14"}


def test_bad_lines_are_split_off(spark):
    lines = spark.createDataFrame([('{"AgentID":"a","Header":{"ExportTime":1},"DataSets":[[{"I":1,"V":18446744073709551615}]]}',), ("{oops",), (None,)], "value string")
    parsed = m.explode_fields(m.explode_records(m.parse_messages(lines))).collect()
    assert [(r.element_id, r.value) for r in parsed] == [(1, "18446744073709551615")]
    assert m.bad_messages(lines).count() == 2


@pytest.mark.parametrize("option", [{"on_error": "x"}, {"reduced_size": "x"}])
def test_options_are_checked(spark, option):
    with pytest.raises(ValueError):
        ix.ipfix_table(datagrams(spark, [b""]), default_elements(spark), **option)

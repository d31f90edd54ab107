"""Cases the fixtures do not have: zero counts, broken messages in reports, unknown elements, odd numbers, shared folders."""

import json
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_datagrams import ETHERNET, IPV4, RECORD, T256, UDP, datagrams, flow_sample, fset, ipfix, raw_header, sflow, tagged, template, v9

from flowlake import session
from flowlake.functions.values import interpret_value
from flowlake.operators import ipfix as ix
from flowlake.operators import messages as m
from flowlake.operators import metrics as mt
from flowlake.operators import netflow9 as n9
from flowlake.operators import packet
from flowlake.operators import records as rc
from flowlake.operators import sflow as sf
from flowlake.operators import sflow_messages as sm
from flowlake.operators import templates as t
from flowlake.sources import sinks
from flowlake.sources.elements import default_elements, load_elements


def test_sflow_counts_of_zero(spark):
    empty_counters = tagged(2, struct.pack(">III", 1, 0x01000005, 0))
    vlan = tagged(2, struct.pack(">III", 1, 0x01000005, 1) + tagged(5, struct.pack(">IQIIII", 1, 9, 3, 4, 5, 6)))
    messages = [sflow(), sflow(flow_sample(), vlan), sflow(empty_counters, flow_sample(raw_header(ETHERNET + IPV4 + UDP)))]
    frame = datagrams(spark, messages, "sflow")
    assert sf.sflow_rejects(frame).count() == 0
    assert sorted(r.msg_id for r in sf.sflow_samples(frame).collect()) == [1, 1, 2, 2]
    assert [r.msg_id for r in sf.sflow_counter_table(frame, "vlan").collect()] == [1]
    assert {r.msg_id: r.l2 is None for r in sf.sflow_packet_table(frame).collect()} == {1: True, 2: False}
    short = datagrams(spark, [sflow(flow_sample())[:-1], sflow(flow_sample())[:24] + struct.pack(">I", 1)], "sflow")
    assert sf.sflow_rejects(short).count() == 2


def test_ipv4_options_count(spark):
    words = bytes([0x46, *IPV4[1:9], 6, *IPV4[10:20]]) + b"\x01\x01\x01\x00"
    tcp = struct.pack(">HHIIHHHH", 1000, 2000, 1, 2, (5 << 12) | 0x12, 64, 0, 0)
    rows = [(1, bytearray(ETHERNET + words + tcp)), (1, bytearray(ETHERNET + words + tcp[:16]))]
    read = packet.packet_layers(spark.createDataFrame(rows, "protocol int, header binary")).collect()
    assert [r.packet_error for r in read] == [None, "short TCP header"] and read[0].l4_tcp.SrcPort == 1000


def test_unknown_elements_as_bytes(spark):
    frame = datagrams(spark, [ipfix(fset(2, template(256, (8, 4), (31999, 2)))), ipfix(fset(256, RECORD * 2))])
    elements = default_elements(spark)
    assert ix.ipfix_table(frame, elements).count() == 0
    read = m.explode_fields(ix.ipfix_table(frame, elements, on_unknown="hex")).collect()
    assert [(r.element_id, r.value) for r in read] == [(8, "10.0.0.14"), (31999, "0x094c")] * 2
    assert ix.ipfix_report(frame, elements).collect()[0].reason == "unknown element"
    assert ix.ipfix_report(frame, elements, on_unknown="hex").count() == 0
    with pytest.raises(ValueError, match="on_unknown"):
        ix.ipfix_table(frame, elements, on_unknown="keep")


def test_late_elements_are_built_in(spark):
    assert default_elements(spark).count() == 460
    record = bytes([10, 0, 0, 1]) + struct.pack(">IQ", 77, 5) + b"\x02"
    fields = template(256, (8, 4), (283, 4), (280, 8), (229, 1))
    frame = datagrams(spark, [ipfix(fset(2, fields)), ipfix(fset(256, record * 2))])
    read = m.explode_fields(ix.ipfix_table(frame, default_elements(spark))).collect()
    assert [(r.element_id, r.value) for r in read] == [(8, "10.0.0.1"), (283, "77"), (280, "5"), (229, "2")] * 2
    lists = datagrams(spark, [ipfix(fset(2, template(256, (8, 4), (291, 3)))), ipfix(fset(256, record[:4] + b"\x01\x02\x03"))])
    read = m.explode_fields(ix.ipfix_table(lists, default_elements(spark))).collect()
    assert [(r.element_id, r.value) for r in read] == [(8, "10.0.0.1"), (291, "0x010203")]


def test_reports_name_every_loss(spark):
    partial = RECORD * 2 + RECORD[:5]
    broken_template = fset(2, template(300, (8, 4), (7, 2))[:8])
    frame = datagrams(spark, [
        ipfix(fset(2, T256)),
        ipfix(broken_template),  # no data set to report
        ipfix(struct.pack(">HH", 256, 2) + b"\x00\x00"),  # no good set header at all
        ipfix(fset(256, RECORD), fset(256, partial), fset(256, RECORD)),  # two good sets fall with one
    ])
    elements = default_elements(spark)
    report = {(r.set_id, r.reason): r.n for r in ix.ipfix_report(frame, elements).collect()}
    assert report.pop((256, "set does not end on a record")) == 1 and report.pop((256, "message dropped")) == 2
    assert len(report) == 2 and all(set_id is None and n == 1 for (set_id, _), n in report.items())
    kept = {(r.set_id, r.reason) for r in ix.ipfix_report(frame, elements, on_error="keep_sets").collect()}
    assert (256, "message dropped") not in kept
    nine = datagrams(spark, [v9(fset(0, T256)), v9(fset(256, RECORD), fset(256, partial), fset(256, RECORD))], "netflowv9")
    report = {(r.set_id, r.reason): r.n for r in n9.netflow9_report(nine, elements).collect()}
    assert report == {(256, "set does not end on a record"): 1, (256, "message dropped"): 1}


def test_domains_behind_one_agent(spark, tmp_path):
    """Both domains use id 256, the second with source and destination the other way round."""

    def message(domain, *sets):
        return ipfix(*sets)[:12] + struct.pack(">I", domain) + ipfix(*sets)[16:]

    pair = bytes([10, 0, 0, 1, 10, 0, 0, 2])
    frame = datagrams(spark, [
        message(1, fset(2, template(256, (8, 4), (12, 4)))), message(2, fset(2, template(256, (12, 4), (8, 4)))),
        message(1, fset(256, pair)), message(2, fset(256, pair)), message(1, fset(256, pair[:5])),
    ])
    elements = default_elements(spark)

    def sources(table):
        return {r.msg_id: r.value for r in m.explode_fields(table).where("element_id = 8").collect()}

    assert sources(ix.ipfix_table(frame, elements)) == {2: "10.0.0.2", 3: "10.0.0.2"}
    apart = rc.with_domain(frame, t.IPFIX)
    assert sources(ix.ipfix_table(apart, elements)) == {2: "10.0.0.1", 3: "10.0.0.2"}
    assert {(r.domain, r.reason) for r in ix.ipfix_report(apart, elements).collect()} == {(1, "set does not end on a record")}
    sinks.save_templates(t.template_registry(ix.template_table(apart), ("agent", "domain")), str(tmp_path / "r"))
    registry = sinks.load_templates(spark, str(tmp_path / "r"), domain=True)
    later = rc.with_domain(datagrams(spark, [b"", b"", b"", message(1, fset(256, pair))]), t.IPFIX)
    assert sources(ix.ipfix_table(later, elements, registry)) == {3: "10.0.0.1"}


@pytest.mark.parametrize("n", [3, 4, 5, 64, 65, 300])
def test_messages_of_many_sets(spark, n):
    frame = datagrams(spark, [ipfix(fset(2, T256)), ipfix(*[fset(256, RECORD)] * n)])
    assert ix.ipfix_table(frame, default_elements(spark)).count() == n


def test_json_keeps_what_is_no_number(spark):
    fields = "array<array<struct<I:int,V:string,E:bigint,num:boolean>>>"
    rows = [("a", (10,), [[(1, "NaN", 0, True), (2, "Infinity", 0, True), (3, "7", 0, True)]])]
    messages = spark.createDataFrame(rows, f"AgentID string, Header struct<Version:int>, DataSets {fields}")
    for flat, expected in ((False, [[{"I": 1, "V": "NaN"}, {"I": 2, "V": "Infinity"}, {"I": 3, "V": 7}]]), (True, [{"1": "NaN", "2": "Infinity", "3": 7}])):
        assert json.loads(m.encode_message(messages, flat).first().value)["DataSets"] == expected


VALUES = [
    ("unsigned8", b"\xff", "255"),
    ("unsigned16", b"\x01\x00", "256"),
    ("unsigned32", b"\xff" * 4, "4294967295"),
    ("unsigned64", b"\xff" * 8, "18446744073709551615"),
    ("unsigned16", b"\x01\x00\x07", "256"),  # longer: the leading bytes
    ("unsigned32", b"\x01\x02", "0x0102"),  # shorter: as it is
    ("signed8", b"\xff", "-1"),
    ("signed16", b"\x80\x00", "-32768"),
    ("signed32", b"\xff\xff\xff\xfe", "-2"),
    ("signed64", b"\x80" + b"\x00" * 7, "-9223372036854775808"),
    ("float32", struct.pack(">f", -1.5), "-1.5"),
    ("float64", struct.pack(">d", 0.1), "0.1"),
    ("boolean", b"\x01", "true"),
    ("boolean", b"\x02", "false"),
    ("macAddress", b"\x01\x02\x03\x04\x05\xff", "01:02:03:04:05:ff"),
    ("string", "né".encode(), "né"),
    ("octetArray", b"\x00\xab", "0x00ab"),
    ("ipv4Address", b"\x0a\x00\x00\x01", "10.0.0.1"),
    ("ipv6Address", b"\x00" * 15 + b"\x01", "::1"),
    ("dateTimeSeconds", b"\x00\x00\x00\x05", "5"),
    ("dateTimeMilliseconds", b"\x00" * 7 + b"\x06", "6"),
    ("dateTimeMicroseconds", b"\x00" * 7 + b"\x07", "7"),
    ("dateTimeNanoseconds", b"\x00" * 7 + b"\x08", "8"),
]


def test_values_of_every_type(spark):
    frame = spark.createDataFrame([(k, t, bytearray(raw)) for k, (t, raw, _) in enumerate(VALUES)], "k int, t string, raw binary")
    read = frame.select("k", interpret_value(F.col("raw"), F.col("t")).alias("v")).orderBy("k").collect()
    assert [r.v for r in read] == [v for _, _, v in VALUES]
    wide = spark.createDataFrame([("unsigned32", bytearray(b"\x01\x02")), ("signed32", bytearray(b"\xff\xfe"))], "t string, raw binary")
    assert [Decimal(r.v) for r in wide.select(interpret_value(F.col("raw"), F.col("t"), "widen").alias("v")).collect()] == [258, -2]


def test_dictionaries_of_several_files(spark, tmp_path):
    for name, rows in (("a.json", {"0": {"40000": ["one", "string"]}}), ("b.json", {"9": {"1": ["two", "unsigned8"]}})):
        (tmp_path / name).write_text(json.dumps(rows))
    assert sorted(tuple(r) for r in load_elements(spark, str(tmp_path)).collect()) == [(0, 40000, "one", "string"), (9, 1, "two", "unsigned8")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.json").write_text("{}")
    with pytest.raises(ValueError, match="no elements"):
        load_elements(spark, str(tmp_path / "none"))


def test_raw_copies_in_one_pass(spark, tmp_path):
    frame = datagrams(spark, [b"a"], agent="10.0.0.1").unionByName(datagrams(spark, [b"b"], agent="fe80::1"))
    sinks.tee_raw(frame, str(tmp_path / "raw"))
    read = spark.read.parquet(str(tmp_path / "raw"))
    assert {(r.agent, r.family) for r in read.collect()} == {("10.0.0.1", "ipv4"), ("fe80::1", "ipv6")}


class Conf(dict):
    @property
    def conf(self):
        return self


def test_scratch_must_be_shared():
    folders = {"spark.sql.warehouse.dir": "file:/home/x/warehouse"}
    assert session.shared_folder(Conf(folders | {"spark.master": "local[4]"})) == "file:/home/x/warehouse/_scratch"
    assert session.shared_folder(Conf(folders | {"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:/c"})) == "hdfs:/c"
    assert session.shared_folder(Conf({"spark.master": "yarn", "spark.sql.warehouse.dir": "hdfs://n/w"})) == "hdfs://n/w/_scratch"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Conf(folders | {"spark.master": master}))


def test_sflow_messages(spark):
    """Records that a sample lacks are absent, bad and excluded samples are left out, and nothing is shuffled."""
    switch = tagged(1001, struct.pack(">4I", 7, 1, 8, 2))
    counters = tagged(2, struct.pack(">3I", 5, 9, 1) + tagged(5, struct.pack(">IQ4I", 3, 2**63 + 1, 1, 2, 3, 4)))
    plain, arp = flow_sample(raw_header(ETHERNET + IPV4 + UDP), switch), flow_sample(raw_header(b"\x00" * 12 + b"\x08\x06" + b"\x00" * 40))
    frame = datagrams(spark, [sflow(plain, counters), sflow(arp, counters), sflow(flow_sample()), sflow(tagged(99, b"\x00" * 4))], "sflow")

    def lines(**options):
        messages = sm.sflow_messages(frame, **options)
        assert "Exchange" not in messages._jdf.queryExecution().toString()
        return {row.msg_id: row.value for row in m.encode_struct(messages, sm.MESSAGE).collect()}

    found = {k: json.loads(v) for k, v in lines().items()}
    assert sorted(found) == [0, 2]  # the ARP frame spoils its datagram, the last one has no sample of a known format
    first = found[0]
    assert list(first) == sm.MESSAGE and sorted(first["Samples"][0]["Records"]) == ["ExtSwitch", "RawHeader"]
    assert sorted(first["Samples"][0]["Records"]["RawHeader"]["L4"]) == ["DstPort", "SrcPort"]
    assert first["Counters"][0]["Records"] == {
        "Vlan": {"ID": 3, "Octets": 2**63 + 1, "UnicastPackets": 1, "MulticastPackets": 2, "BroadcastPackets": 3, "Discards": 4}
    }
    assert found[2]["Samples"][0]["Records"] == {} and found[2]["Counters"] == []
    kept = {k: json.loads(v) for k, v in lines(on_error="keep_samples").items()}
    assert sorted(kept) == [0, 1, 2] and kept[1]["Samples"] == [] and len(kept[1]["Counters"]) == 1
    assert sorted(lines(exclude_types=[2])) == [0, 2] and sorted(lines(exclude_types=[1])) == [0, 1]
    parsed = m.parse_messages(spark.createDataFrame([(lines()[0],)], "value string"), "sflow").first()
    assert parsed.Counters[0].Records.Vlan.Octets == 2**63 + 1 and parsed.Samples[0].Records.ExtRouter is None


@pytest.mark.parametrize("bucket", ["minute", "day", "year"])
def test_rates_do_not_depend_on_buckets(spark, bucket):
    """Gaps of many buckets, restarts, repeated times and null times; against one loop over each run."""
    polls = [("a", "ipfix", 0, s, s * 3, s * 2, s // 5) for s in (0, 10, 10, 70, 4000, 90000, 90010, 500000)]
    polls += [("a", "ipfix", 1, 500001 + s, 5 * s, s, 0) for s in (0, 3, 7)] + [("a", "ipfix", 1, 500009, 1, 1, 0), ("b", "sflow", 0, None, 4, 4, 4), ("b", "sflow", 0, 5, 9, 9, 9)]
    rows = spark.createDataFrame(polls, "host string, proto string, start_time bigint, s bigint, udp_count bigint, decoded_count bigint, mq_error_count bigint")
    got = mt.counter_rates(rows.withColumn("ts", F.timestamp_seconds("s")).repartition(5), bucket).collect()
    want, before = [], {}
    for host, proto, start, s, *counts in sorted(polls, key=lambda p: (p[:3], -1 if p[3] is None else p[3], p[4:])):
        last, held = before.get((host, proto, start), (None, None))
        gap = None if None in (last, s) else s - last
        rates = [None if not gap or n < h else (n - h) // gap for n, h in zip(counts, held or counts, strict=True)]
        want.append((host, start, s, *counts, *rates))
        before[host, proto, start] = s, counts
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(((r.host, r.start_time, r.s, r.udp_count, r.decoded_count, r.mq_error_count, r.udp_rate, r.decode_rate, r.mq_error_rate) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bucket", ["minute", "hour", "year"])
def test_versions_do_not_depend_on_buckets(spark, bucket):
    """Repeats inside and across buckets, buckets that hold only repeats, and changes at their edges."""
    seen = [(0, "x"), (10, "x"), (65, "x"), (200, "y"), (230, "x"), (300, "x"), (4000, "x"), (7300, "y"), (7300, "z"), (90000, "z"), (200000, "x")]
    rows = [("e", 256, s, i, 0, 0, kind) for i, (s, kind) in enumerate(seen)] + [(None, 257, 5, 99, 0, 0, "x"), (None, 257, 9000, 100, 0, 0, "y")]
    frame = spark.createDataFrame(rows, "agent string, template_id int, s bigint, msg_id bigint, set_ix int, rec_ix int, kind string")
    frame = frame.withColumns({"recv_ts": F.timestamp_seconds("s"), "fields": F.array("kind")}).drop("s", "kind").repartition(4)
    got = {(v.agent, v.valid_from.msg_id, v.fields[0], v.valid_to and v.valid_to.msg_id) for v in t.template_versions(frame, bucket=bucket).collect()}
    assert got == {("e", 0, "x", 3), ("e", 3, "y", 4), ("e", 4, "x", 7), ("e", 7, "y", 8), ("e", 8, "z", 10), ("e", 10, "x", None), (None, 99, "x", 100), (None, 100, "y", None)}


@pytest.mark.parametrize("layout", [None, "date_src_time"])
def test_a_batch_counts_once(spark, tmp_path, layout):
    """A batch written again, also after a part of it was written, leaves the table as it was; other batches add to it."""
    path, table = str(tmp_path / "flows"), f"once_{layout}"
    rows = spark.range(40).select(
        F.expr("date_add(DATE'2024-01-01', CAST(id % 4 AS INT))").alias("date"), F.col("id").cast("string").alias("src"), F.timestamp_seconds("id").alias("time")
    )
    for batch, part in (("a-0", rows.where("src < '2'")), ("a-0", rows), ("a-0", rows), ("a-1", rows.limit(0)), ("b-0", rows)):
        sinks.append_flows(part, path, layout=layout, table=table, batch=batch)
    assert {tuple(r) for r in spark.table(table).groupBy("batch").agg(F.count("*"), F.countDistinct("src")).collect()} == {("a-0", 40, 40), ("b-0", 40, 40)}
    assert spark.read.parquet(path).count() == 80


def test_append_to_a_catalog_table(spark, tmp_path):
    for _ in range(2):
        sinks.append_flows(spark.range(3).toDF("n"), str(tmp_path / "t"), table="plain_flows")
    assert spark.table("plain_flows").count() == 6


class _Writer:
    """Stands for a DataFrame and its writer; notes what is called."""

    def __init__(self, streaming):
        self.isStreaming, self.calls = streaming, {}

    write = writeStream = property(lambda self: self)

    def __getattr__(self, name):
        def note(*args, **named):
            self.calls[name] = args or named
            return "query" if name == "start" else self

        return note

    def options(self, **named):
        self.calls.setdefault("options", {}).update(named)
        return self


def test_published_messages():
    batch, stream = _Writer(False), _Writer(True)
    sinks.publish_messages(batch, "one:9092,two:9092", "flows", **{"compression.type": "snappy", "retries": "2"})
    assert batch.calls["select"] == ("value",) and batch.calls["format"] == ("kafka",) and "save" in batch.calls
    assert batch.calls["options"] == {
        "kafka.bootstrap.servers": "one:9092,two:9092", "topic": "flows", "kafka.compression.type": "snappy", "kafka.retries": "2"
    }
    assert sinks.publish_messages(stream, "one:9092", "flows", checkpoint="/c") == "query"
    assert stream.calls["option"] == ("checkpointLocation", "/c") and "save" not in stream.calls

"""Work is dealt into tasks, batches and states by the size of the input."""

import datetime as dt
import struct

from pyspark.sql import functions as F

from flowlake.operators import messages as m
from flowlake.plans import catalog
from flowlake.plans import fixtures as fx
from flowlake.sources import sinks
from flowlake.sources.datagrams import DATAGRAM_SCHEMA, read_datagrams
from flowlake.streaming import jobs
from flowlake.streaming.templates_state import stream_resolve_templates


def test_tasks_grow_with_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 50)
    spark.range(2000).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    rows = fx.table(spark, str(tmp_path), "events")
    assert rows.rdd.getNumPartitions() == 40
    assert rows.count() == 2000


def test_batches_hold_more_files_where_there_are_more(spark, tmp_path):
    stream = catalog._staged_stream(spark, spark.range(120).repartition(12), str(tmp_path / "in"))
    sizes = []
    jobs.start(stream, str(tmp_path / "c"), None, sink=lambda batch, epoch: sizes.append(batch.count())).awaitTermination()
    assert len(sizes) == 3
    assert sum(sizes) == 120


def test_in_order_keeps_tasks_and_gives_two_batches(spark, tmp_path):
    times = [dt.datetime(1990 + i % 16, 1, 2) for i in range(160)]
    rows = spark.createDataFrame([("a", "ipfix", time, i, bytearray(b"x")) for i, time in enumerate(times)], DATAGRAM_SCHEMA)
    seen = []

    def keep(batch, epoch):
        seen.append((epoch, batch.count(), len(list((tmp_path / "in").glob("*.parquet"))), batch.agg(F.max(F.year("recv_ts")) < 1998).first()[0]))

    for stream in catalog._in_order(spark, rows.repartition(8), str(tmp_path)):
        jobs.start(stream, str(tmp_path / "c"), None, sink=keep).awaitTermination()
    assert [(epoch, n, early) for epoch, n, _, early in seen] == [(0, 80, True), (1, 80, False)]
    assert [files for _, _, files, _ in seen] == [8, 16]


def ipfix(*sets):
    body = b"".join(struct.pack(">HH", number, len(content) + 4) + content for number, content in sets)
    return struct.pack(">HHIII", 10, 16 + len(body), 1700000000, 1, 7) + body


def test_template_keys_share_a_state(spark, tmp_path):
    def template(element):
        return 2, struct.pack(">HHHH", 300, 1, element, 4)

    data = (300, b"\0\0\0\1")
    sent = [("a", ipfix(template(8))), ("b", ipfix(template(12))), ("a", ipfix(data)), ("b", ipfix(data)), ("c", ipfix(data)), (None, ipfix(data))]
    rows = [(agent, "ipfix", dt.datetime(2024, 1, 1, 0, 0, i), i, bytearray(p)) for i, (agent, p) in enumerate(sent)]
    # templates in the first batch, their sets in the second
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, DATAGRAM_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        resolved = stream_resolve_templates(read_datagrams(spark, str(tmp_path / "in"), stream=True), wait=False, groups=1)
        jobs.start(resolved, str(tmp_path / "c"), None, path=str(tmp_path / "out")).awaitTermination()
    out = spark.read.schema(resolved.schema).parquet(str(tmp_path / "out")).collect()
    assert {(r.agent, r.msg_id, r.fields and r.fields[0].element_id) for r in out} == {("a", 2, 8), ("b", 3, 12), ("c", 4, None), (None, 5, None)}


def test_numbers_in_messages(spark):
    values = ["0", "7", "-12", "999999999999999999", "18446744073709551615", "1.5", "-0", "007", "NaN", "true", " 3", "+3", None]
    field = "named_struct('I', 1, 'V', v, 'E', CAST(0 AS BIGINT), 'num', true)"
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = rows.selectExpr("i", "'a' AS AgentID", "named_struct('x', 1) AS Header", f"array(array({field})) AS DataSets")
    parsed = F.try_parse_json(F.get_json_object("value", "$.DataSets[0][0].V")).cast("string")
    out = {r.i: r for r in m.encode_message(rows).select("i", "value", parsed.alias("v")).collect()}
    assert [out[i].value.split('"V":')[1][:-4] for i in range(5)] == values[:5]
    assert '"V":1.5' in out[5].value
    assert '"V":"007"' in out[7].value
    assert '"V":"NaN"' in out[8].value
    assert '"V":true' in out[9].value
    assert '"V"' not in out[12].value


def test_layout_computes_flows_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(value):
        calls.add(1)
        return value

    rows = spark.range(50).select(F.udf(seen, "long")("id").alias("src"), F.to_date(F.lit("2024-01-01")).alias("date"), F.lit(1).alias("time"))
    sinks.append_flows(rows, str(tmp_path / "flows"), layout="date_src_time")
    assert calls.value == 50
    assert spark.read.parquet(str(tmp_path / "flows")).count() == 50

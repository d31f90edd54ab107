"""Decoding streams: state from a saved registry, domains, waiting sets, repeated batches."""

import datetime as dt

from pyspark.sql import functions as F
from test_datagrams import BASE, RECORD, T256, fset, ipfix, template

from flowlake.operators import ipfix as ix
from flowlake.operators import records as r
from flowlake.operators import replay as rp
from flowlake.operators import templates as t
from flowlake.session import stored
from flowlake.sources import sinks
from flowlake.sources.datagrams import DATAGRAM_SCHEMA
from flowlake.sources.elements import default_elements
from flowlake.streaming import decode

OTHER = template(256, (7, 2), (8, 4))
TURNED = RECORD[4:] + RECORD[:4]


def in_domain(message, domain):
    return message[:12] + domain.to_bytes(4, "big") + message[16:]


def frame_of(spark, rows):
    """Rows of (seconds, message number, payload)."""
    return spark.createDataFrame([("10.0.0.1", "ipfix", BASE + dt.timedelta(seconds=s), i, bytearray(p)) for s, i, p in rows], DATAGRAM_SCHEMA)


def staged(spark, folder, *batches):
    """Files that stream one batch at a time, in order."""
    for rows in batches:
        frame_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(DATAGRAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def sources(spark, path, part):
    rows = spark.read.parquet(f"{path}/{part}").select("msg_id", "fields").collect()
    return sorted((row.msg_id, next(f.V for f in row.fields if f.I == 8)) for row in rows)


def run(spark, stream, tmp_path, **options):
    out = str(tmp_path / "out")
    decode.stream_records(stream, t.IPFIX, default_elements(spark), out, str(tmp_path / "check"), trigger=None, **options).awaitTermination()
    return out


def test_state_from_a_saved_registry_and_by_domain(spark, tmp_path):
    """A stream without announcements resolves from a loaded registry; two domains of one agent stay apart."""
    announced = frame_of(spark, [(0, 0, in_domain(ipfix(fset(2, T256)), 1)), (1, 1, in_domain(ipfix(fset(2, OTHER)), 2))])
    registry = t.template_registry(t.template_records(r.with_domain(announced, t.IPFIX), t.IPFIX), ("agent", "domain"))
    sinks.save_templates(registry, str(tmp_path / "registry"))
    known = sinks.load_templates(spark, str(tmp_path / "registry"), domain=True)
    data = [in_domain(ipfix(fset(256, RECORD)), 1), in_domain(ipfix(fset(256, TURNED)), 2), in_domain(ipfix(fset(256, RECORD)), 3)]
    stream = staged(spark, str(tmp_path / "in"), [(10, 10, data[0]), (11, 11, data[1])], [(12, 12, data[0]), (13, 13, data[1]), (14, 14, data[2])])
    out = run(spark, r.with_domain(stream, t.IPFIX), tmp_path, registry=known)
    assert sources(spark, out, "records") == [(i, "10.0.0.14") for i in (10, 11, 12, 13)]


def test_sets_wait_for_their_template(spark, tmp_path):
    early = (0, 0, ipfix(fset(256, RECORD)))
    lost = (1, 1, ipfix(fset(999, RECORD)))
    stream = staged(
        spark, str(tmp_path / "in"), [early, lost], [(5, 2, ipfix(fset(256, RECORD))), (6, 3, ipfix(fset(2, T256)))],
        [(7, 4, ipfix(fset(256, RECORD)))], [(500, 5, ipfix(fset(2, OTHER), fset(256, TURNED)))],
    )
    out = run(spark, stream, tmp_path, max_age="1 minute")
    assert [i for i, _ in sources(spark, out, "records")] == [4, 5]
    assert sources(spark, out, "replayed") == [(0, "10.0.0.14"), (2, "10.0.0.14")]
    verdicts = spark.read.parquet(out + "/verdicts").select("msg_id", "template_id", "attempts", "verdict").collect()
    assert [tuple(v) for v in verdicts] == [(1, 999, 3, "template never came")]
    assert spark.read.parquet(out + "/waiting/1").count() == 0  # the fourth batch is number 3


def test_replay_verdicts(spark):
    """A later template may be of another length, or hold an element that is not known."""
    rows = [(0, 0, ipfix(fset(256, RECORD))), (1, 1, ipfix(fset(257, RECORD + RECORD[:5]))), (2, 2, ipfix(fset(258, RECORD))), (3, 3, ipfix(fset(259, RECORD)))]
    later = [ipfix(fset(2, T256)), ipfix(fset(2, template(257, (8, 4), (7, 2)))), ipfix(fset(2, template(258, (30000, 6))))]
    frame = frame_of(spark, rows + [(10 + k, 10 + k, p) for k, p in enumerate(later)])
    elements = default_elements(spark)
    status = r.set_status(r.resolved_sets(frame, t.IPFIX, *r.versions_and_layouts(frame, t.IPFIX, elements)), t.IPFIX)
    waiting = stored(rp.waiting_sets(status))
    assert waiting.count() == 4
    done = rp.replay(waiting, r.announcements(frame, t.IPFIX), t.IPFIX, elements, F.lit(BASE + dt.timedelta(seconds=20)), "1 hour")
    assert [row.msg_id for row in done.records.collect()] == [0] and [row.msg_id for row in done.waiting.collect()] == [3]
    assert sorted((v.msg_id, v.verdict) for v in done.verdicts.collect()) == [(1, "set does not end on a record"), (2, "unknown element")]
    assert all(row.Header.ExportTime == 1700000000 for row in done.records.collect())


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """Batch functions overwrite what they wrote: state folders alternate, output folders carry the batch number."""
    first, second = frame_of(spark, [(0, 0, ipfix(fset(2, T256)))]), frame_of(spark, [(1, 1, ipfix(fset(256, RECORD)))])
    held = {}
    original, decode.start = decode.start, lambda frame, checkpoint, trigger, sink: held.update(sink=sink)
    try:
        decode.stream_records(first, t.IPFIX, default_elements(spark), str(tmp_path / "out"), "unused")
    finally:
        decode.start = original
    for batch, epoch in ((first, 0), (second, 1), (second, 1), (second, 2)):
        held["sink"](batch, epoch)
    assert spark.read.parquet(str(tmp_path / "out" / "records")).groupBy("batch").count().orderBy("batch").collect() == [(1, 1), (2, 1)]
    assert ix.ipfix_table(second, default_elements(spark)).count() == 0

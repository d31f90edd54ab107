"""Template sets are read by whole batches, and what jobs read several times is worked out once."""

import random
import struct

import pyarrow as pa
import pytest

from flowlake.functions.announced import CUT_SHORT, read_announced
from flowlake.operators import netflow9 as n9
from flowlake.operators import records as r
from flowlake.operators import templates as t
from flowlake.plans import catalog
from flowlake.plans import fixtures as fx

D = "/root/testdata/sf0.001"


def words(*values):
    return b"".join(struct.pack(">H", v) for v in values)


def plain(body, options, enterprise):
    """The templates of one set, read one number after the other."""
    out, pos, end = [], 0, len(body) // 2
    h = [body[2 * i] * 256 + body[2 * i + 1] for i in range(end)]
    while len(body) - 2 * pos > 4 and h[pos]:
        if end - pos < 2 + options:
            return out, CUT_SHORT
        head = h[pos : pos + 2 + options]
        if not options:
            need, scope = head[1], 0
        elif enterprise:
            need, scope = head[1:]
        else:
            need, scope = head[1] // 4 + head[2] // 4, head[1] // 4
        pos += len(head)
        fields = []
        for _ in range(need):
            size = 4 if enterprise and pos < end and h[pos] >= 32768 else 2
            if end - pos < size:
                return out, CUT_SHORT
            own = h[pos + 2] * 65536 + h[pos + 3] if size == 4 else 0
            element = h[pos] & 32767 if enterprise else h[pos]
            fields.append({"element_id": element, "length": h[pos + 1], "enterprise": own, "scope": len(fields) < scope})
            pos += size
        out.append((head[0], fields))
    return out, None


def noise(draw, options, enterprise):
    body = b""
    for _ in range(draw.choice([0, 1, 1, 2, 3])):
        n = draw.choice([0, 1, 2, 5, 13])
        fields = []
        for _ in range(max(0, n + draw.choice([0, 0, 0, -1, 1]))):
            element = draw.choice([1, 8, 12, 32769, 65535, 0])
            fields += [element, draw.choice([1, 4, 65535])] + ([draw.choice([0, 9, 65535]), 29305] if element >= 32768 and enterprise else [])
        counts = [n] if not options else [n, draw.choice([0, 1, 2])] if enterprise else [draw.choice([0, 4, 5, 8]), draw.choice([0, 4, 11])]
        body += words(draw.choice([256, 257, 0]), *counts, *fields)
    body += bytes(draw.choice([0, 0, 1, 2, 3, 4, 5]))
    return body[: len(body) - draw.choice([0, 0, 0, 1, 3])]


@pytest.mark.parametrize("framing", [t.IPFIX, t.NETFLOW9])
def test_batches_are_read_as_one_set_after_the_other(framing):
    draw = random.Random(7)
    payloads, sets, expected = [], [], []
    for _ in range(600):
        payload, listed, found, error = b"head", [], [], None
        for ix in range(draw.choice([0, 1, 2, 4])):
            set_id = draw.choice([framing.template_set, framing.option_set, 300])
            body = noise(draw, set_id == framing.option_set, framing.enterprise)
            listed.append({"set_id": set_id, "off": len(payload), "len": len(body)})
            payload += body
            if set_id != 300:
                got, bad = plain(body, set_id == framing.option_set, framing.enterprise)
                error = error or bad
                found += [
                    {"set_ix": ix, "set_id": set_id, "rec_ix": k, "template_id": template, "fields": fields}
                    for k, (template, fields) in enumerate(got)
                ]
        payloads.append(payload), sets.append(listed), expected.append((found, error))
    kind = pa.list_(pa.struct([("set_id", pa.int32()), ("off", pa.int32()), ("len", pa.int32())]))
    form = (framing.template_set, framing.option_set, framing.enterprise)
    for begin, n in ((0, 600), (101, 300), (5, 0)):  # a slice of a batch as well
        some = [pa.array(payloads, pa.binary()).slice(begin, n), pa.array(sets, kind).slice(begin, n)]
        templates, error = read_announced(*some, *form)
        assert list(zip(templates.to_pylist(), error.to_pylist(), strict=True)) == expected[begin : begin + n]
    assert any(e for _, e in expected) and any(len(f) > 2 for f, _ in expected)


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_template_is_read_in_a_lambda(spark):
    datagrams = fx.netflow9_datagrams(spark, D, True)
    for job in (t.template_records, t.data_sets, t.message_errors):
        text = plan(job(datagrams, t.NETFLOW9))
        assert "MapInArrow" in text and "template cut short" not in text


def test_values_are_read_once(spark):
    """The filter that an explode brings along read every value a second time."""
    fields = catalog._record_fields(n9.netflow9_table(fx.netflow9_datagrams(spark, D), fx.element_dictionary(spark)))
    assert not [line for line in plan(fields).splitlines() if "Filter" in line and "transform(" in line]


@pytest.mark.parametrize("query", ["unresolved_report", "replay_unresolved", "netflow9_report"])
def test_datagrams_read_several_times_are_packed_once(spark, query):
    assert "orders.parquet" not in str(catalog.QUERIES[query](spark, D).inputFiles())


def test_announcements_with_a_domain_and_further_columns(spark):
    datagrams = fx.ipfix_datagrams(spark, D, True).selectExpr("*", "named_struct('x', msg_id) AS extra")
    known = r.announcements(r.with_domain(datagrams, t.IPFIX), t.IPFIX)
    assert known.columns == ["agent", "domain", "template_id", *t.ORDER, "rec_ix", "fields"] and known.count() > 0
    assert "extra" in t.data_sets(datagrams, t.IPFIX).columns

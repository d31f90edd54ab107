"""The driver tables as flow telemetry: messages, datagrams and collector statistics.

Everything here is built row by row from one table (or one equi join), so the fixtures
have no grouping of their own and grow with the tables. A source row becomes one message
with one to three records, called legs: leg 0 runs from source to destination, leg 1 runs
back, leg 2 is a variant stated at each fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import settle
from flowlake.functions.elements import built_in_rows
from flowlake.operators.messages import encode_message
from flowlake.sources.elements import ELEMENT_SCHEMA

FIXTURE_ENTERPRISE = 29305
#: Tables whose rows are dealt out by these keys, so many rows to a task.
LARGE_TABLES = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "events": ["event_id"]}
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str, by: list[str] | None = None) -> DataFrame:
    """A driver table; its zone-less times are UTC instants. A large one is dealt out by the keys ``by``."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in LARGE_TABLES:  # packing rows into datagrams is heavy on the processor, so spread them
        # by keys, as dealing in turns sorts all rows first; the number of tasks grows with the (stored) number of rows
        tasks = max(spark.sparkContext.defaultParallelism, frame.count() // TASK_ROWS)
        frame = frame.repartition(tasks, *(by or LARGE_TABLES[name]))
    times = [c for c, kind in frame.dtypes if kind == "timestamp_ntz"]
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else frame


def element_dictionary(spark: SparkSession) -> DataFrame:
    """Built-in elements and one enterprise element (octets of the way back)."""
    rows = built_in_rows() + [(FIXTURE_ENTERPRISE, 1, "reverseOctetDeltaCount", "unsigned64")]
    return spark.createDataFrame(rows, ELEMENT_SCHEMA)


def agent_text(key: str) -> str:
    """Exporter address ``10.a.b.c`` from a key."""
    return f"concat('10.', ({key} div 65536) % 256, '.', ({key} div 256) % 256, '.', {key} % 256)"


def _address(prefix: str, key: str) -> str:
    return f"concat('{prefix}.', ({key} div 256) % 256, '.', {key} % 256)"


# Packing, as SQL text: the low ``n`` bytes of a number, framed sets and tagged records.


def _word(value: str | int, n: int) -> str:
    return _words((value, n))


def _words(*parts: tuple[str | int, int]) -> str:
    """Neighbours of up to eight bytes in all go into one number, as the digits of a number cost far more than shifting it."""
    groups: list[list[tuple[str | int, int]]] = []
    for part in parts:
        if groups and sum(n for _, n in groups[-1]) + part[1] <= 8:
            groups[-1].append(part)
        else:
            groups.append([part])
    digits = [_digits(group) for group in groups]
    return f"unhex({digits[0]})" if len(digits) == 1 else f"unhex(concat({', '.join(digits)}))"


def _digits(parts: list[tuple[str | int, int]]) -> str:
    left, terms = sum(n for _, n in parts), []
    size = left
    for i, (value, n) in enumerate(parts):
        left -= n
        number = f"CAST({value} AS BIGINT)"
        if i:  # what is above the first word is cut off
            number = f"({number} & {256**n - 1})"
        terms.append(f"shiftleft({number}, {8 * left})" if left else number)
    digits = f"lpad(hex({' | '.join(terms)}), 16, '0')"
    return digits if size == 8 else f"substring({digits}, {17 - 2 * size}, {2 * size})"


def _if(condition: str, value: str) -> str:
    return f"IF({condition}, {value}, X'')"


def _set(set_id: str, body: str) -> str:
    return f"concat({_word(set_id, 2)}, {_word(f'length({body}) + 4', 2)}, {body})"


def _tagged(tag: str, body: str, size: int | None = None) -> str:
    return f"concat({_word(tag, 4)}, {_word(size or f'length({body})', 4)}, {body})"


def _datagrams(rows: DataFrame, agent: str, proto: str, time: str, msg_id: str, payload: str) -> DataFrame:
    packed = rows.selectExpr(
        f"{agent_text(agent)} AS agent", f"'{proto}' AS proto", f"{time} AS recv_ts", f"{msg_id} AS msg_id",
        f"{payload} AS payload",
    )
    return settle(packed, "payload")


# ------------------------------------------------------------------ JSON messages


def _field(element_id: int, value: str, num: bool = True, enterprise: int = 0) -> str:
    return (
        f"named_struct('I', {element_id}, 'V', CAST({value} AS STRING), "
        f"'E', CAST({enterprise} AS BIGINT), 'num', {str(num).lower()})"
    )


def line_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``AgentID, Header, DataSets`` from ``lineitem`` joined with ``orders``.

    Leg 1 also carries the enterprise element and, for returned lines, element 214; leg 2
    has IPv6 addresses and states the protocol twice (first as 0).
    """
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey"]).join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    rows = lines.selectExpr(
        f"{agent_text('o_custkey')} AS AgentID",
        "unix_timestamp(o_orderdate) AS export_seconds",
        "l_orderkey AS seq",
        "o_custkey % 16 AS domain",
        "1 + l_linenumber % 3 AS legs",
        f"{_address('192.168', 'l_suppkey')} AS src",
        f"{_address('172.16', 'l_partkey')} AS dst",
        f"{_address('10.255', 'l_suppkey')} AS hop",
        "concat('2001:db8::', lower(hex(l_suppkey + 1))) AS src6",
        "concat('2001:db8:1::', lower(hex(l_partkey + 1))) AS dst6",
        "64512 + l_suppkey AS src_as",
        "65000 + l_partkey AS dst_as",
        "1024 + l_suppkey % 60000 AS src_port",
        "l_partkey % 65536 AS dst_port",
        "CASE l_linenumber WHEN 2 THEN 17 WHEN 3 THEN 1 WHEN 4 THEN 58 ELSE 6 END AS proto",
        "CASE l_returnflag WHEN 'A' THEN '0x10' WHEN 'N' THEN '0x18' ELSE '0x02' END AS flags",
        "IF(l_linestatus = 'F', 536, 728) AS ingress",
        "IF(l_linestatus = 'F', 728, 536) AS egress",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS octets",
        "CAST(l_quantity AS BIGINT) AS packets",
        "unix_millis(l_shipdate) AS start_ms",
        "l_returnflag = 'R' AS stop",
    )
    common = [_field(6, "flags", num=False), _field(2, "packets"), _field(152, "start_ms")]
    there = [
        _field(8, "src", num=False), _field(12, "dst", num=False), _field(15, "hop", num=False),
        _field(4, "proto"), _field(7, "src_port"), _field(11, "dst_port"), _field(16, "src_as"),
        _field(17, "dst_as"), _field(10, "ingress"), _field(14, "egress"), _field(1, "octets"), *common,
    ]
    back = [
        _field(8, "dst", num=False), _field(12, "src", num=False), _field(4, "proto"),
        _field(7, "dst_port"), _field(11, "src_port"), _field(16, "dst_as"), _field(17, "src_as"),
        _field(10, "egress"), _field(14, "ingress"), _field(1, "octets + 1"),
        _field(1, "octets + 7", enterprise=FIXTURE_ENTERPRISE), *common,
    ]
    six = [
        _field(4, "0"), _field(27, "src6", num=False), _field(28, "dst6", num=False),
        _field(62, "'2001:db8:ffff::1'", num=False), _field(4, "proto"), _field(7, "src_port"),
        _field(11, "dst_port"), _field(1, "octets + 2"), *common,
    ]
    back_leg = f"array(concat(array({', '.join(back)}), IF(stop, array({_field(214, '9')}), array())))"
    legs = (
        f"IF(legs IS NULL, NULL, concat(array(array({', '.join(there)})), IF(legs >= 2, {back_leg}, array()), "
        f"IF(legs >= 3, array(array({', '.join(six)})), array())))"
    )
    header = (
        "named_struct('Version', 10, 'Length', 16 + legs * 60, 'ExportTime', export_seconds, "
        "'SequenceNo', seq, 'DomainID', domain)"
    )
    return settle(rows.selectExpr("AgentID", f"{header} AS Header", f"{legs} AS DataSets"), "DataSets")


def line_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as JSON text in ``value``."""
    return settle(encode_message(line_messages(spark, sf_dir)), "value")


# ------------------------------------------------------------------ NetFlow v5


def netflow5_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One v5 packet per ``lineitem`` row with 1 to 3 flows."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate",
        "1 + l_linenumber % 3 AS legs",
        "100000000 + l_orderkey % 1000000 AS uptime",
        "unix_timestamp(l_shipdate) AS secs",
        "(l_partkey % 1000) * 1000000 AS nsecs",
        "3232235520 + l_suppkey % 65536 AS src",
        "2886729728 + l_partkey % 65536 AS dst",
        "184483840 + l_suppkey % 65536 AS hop",
        "IF(l_linestatus = 'F', 536, 728) AS input",
        "IF(l_linestatus = 'F', 728, 536) AS output",
        "CAST(l_quantity AS BIGINT) AS packets",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS octets",
        "1024 + l_suppkey % 60000 AS src_port",
        "l_partkey % 65536 AS dst_port",
        "CASE l_returnflag WHEN 'A' THEN 16 WHEN 'N' THEN 24 ELSE 2 END AS flags",
        "CASE l_linenumber WHEN 2 THEN 17 WHEN 3 THEN 1 WHEN 4 THEN 58 ELSE 6 END AS ip_proto",
        "64512 + l_suppkey AS src_as",
        "65000 + l_partkey AS dst_as",
    )
    header = _words(
        ("5", 2), ("legs", 2), ("uptime", 4), ("secs", 4), ("nsecs", 4), ("l_orderkey", 4), ("l_linenumber", 1),
        ("l_suppkey", 1), ("16384 + l_partkey % 16384", 2),
    )

    def record(leg: int) -> str:
        ends = ("dst", "src") if leg == 1 else ("src", "dst")
        return _words(
            (ends[0], 4), (ends[1], 4), ("hop", 4), ("input", 2), ("output", 2),
            (f"packets + {leg}", 4), (f"octets + {leg}", 4), ("uptime - packets * 1000", 4), (f"uptime - {leg}", 4),
            (f"{ends[0]}_port", 2), (f"{ends[1]}_port", 2), ("0", 1), ("flags", 1), ("ip_proto", 1),
            ("l_linenumber", 1), (f"{ends[0]}_as", 2), (f"{ends[1]}_as", 2), ("24", 1), ("16", 1), ("0", 2),
        )

    payload = f"concat({header}, {record(0)}, {_if('legs >= 2', record(1))}, {_if('legs >= 3', record(2))})"
    return _datagrams(rows, "l_suppkey", "netflowv5", "l_shipdate", "l_orderkey * 8 + l_linenumber", payload)


# ------------------------------------------------------------------ templates (IPFIX, v9)

EMPTY = "X''"
_STATUS_F = "o_orderstatus = 'F'"
_STATUS_P = "o_orderstatus = 'P'"
_ORDER_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderdate",
    "o_orderstatus",
    "o_orderpriority",
    "1 + o_orderkey % 3 AS legs",
    "256 + o_custkey % 25 AS tid",
    "unix_timestamp(o_orderdate) AS secs",
    "unix_millis(o_orderdate) AS millis",
    "3232235520 + o_custkey % 65536 AS src",
    "2886729728 + o_orderkey % 65536 AS dst",
    "1024 + o_custkey % 60000 AS src_port",
    "o_orderkey % 65536 AS dst_port",
    "CAST(round(o_totalprice * 100) AS BIGINT) AS octets",
    "64512 + o_custkey % 1000 AS asn",
    # the template of an agent changes with the priority of the order that announces it
    "IF(o_orderpriority < '4', 10, 14) AS interface_id",
    "o_custkey % 2 = 0 AS wide",
    "o_custkey % 5 = 0 AS named",
]


def _damage(template_set: int) -> str:
    """SQL text of a last, broken set: a template that is cut short for keys divisible by 7, a data set that does not end on a
    record for those that leave 1, nothing for the others."""
    cut_template = _words((template_set, 2), (12, 2), (700, 2), (4, 2), (8, 2), (4, 2))
    partial = f"concat({_words(('tid', 2), (13, 2))}, X'010203040506070809')"
    return f"CASE o_orderkey % 7 WHEN 0 THEN {cut_template} WHEN 1 THEN {partial} ELSE X'' END"


def ipfix_datagrams(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """One IPFIX message per order; some end with a broken set if ``damaged``.

    Orders with status F announce the agent's template first, those with status P announce
    an option template and send one option record; all send 1 to 3 data records. Agents with
    an even key have full-size fields; the others send octets in 4 bytes and flags in 1 (which
    is less than their types). Agents divisible by 5 send the interface name with a variable
    length, the others in 4 bytes. Every data set ends with 3 bytes of padding.
    """
    rows = table(spark, sf_dir, "orders").selectExpr(*_ORDER_COLUMNS)
    template = _words(
        ("tid", 2), ("11", 2), ("8", 2), ("4", 2), ("12", 2), ("4", 2), ("interface_id", 2), ("4", 2), ("4", 2), ("1", 2),
        ("6", 2), ("IF(wide, 2, 1)", 2), ("7", 2), ("2", 2), ("11", 2), ("2", 2), ("1", 2), ("IF(wide, 8, 4)", 2),
        ("152", 2), ("8", 2), ("82", 2), ("IF(named, 65535, 4)", 2), ("32769", 2), ("8", 2), (FIXTURE_ENTERPRISE, 4),
    )
    options = _words(
        ("600", 2), ("3", 2), ("1", 2), ("149", 2), ("4", 2), ("41", 2), ("8", 2), ("42", 2), ("8", 2), ("0", 2)
    )
    name = (
        f"IF(named, concat({_word('length(o_orderpriority)', 1)}, encode(o_orderpriority, 'UTF-8')), "
        "encode(substring(o_orderpriority, 1, 4), 'UTF-8'))"
    )

    def record(leg: int) -> str:
        ends = ("dst", "src") if leg == 1 else ("src", "dst")
        lead = _words((ends[0], 4), (ends[1], 4), (500 + leg, 4), ([6, 17, 1][leg], 1))
        flags = f"IF(wide, {_word('16', 2)}, {_word('16', 1)})"
        ports = _words(("src_port", 2), ("dst_port", 2))
        octets = f"IF(wide, {_word(f'octets + {leg}', 8)}, {_word(f'octets + {leg}', 4)})"
        return f"concat({lead}, {flags}, {ports}, {octets}, {_word(f'millis + {leg}', 8)}, {name}, {_word(f'octets + {leg + 7}', 8)})"

    data = f"concat({record(0)}, {_if('legs >= 2', record(1))}, {_if('legs >= 3', record(2))}, X'000000')"
    option_data = _words(("o_custkey % 16", 4), ("o_orderkey", 8), ("legs", 8))
    framed = rows.selectExpr("*", f"{template} AS template", f"{options} AS options", f"{data} AS data", f"{option_data} AS option_data")
    sets = (
        f"concat({_if(_STATUS_F, _set('2', 'template'))}, "
        f"{_if(_STATUS_P, _set('3', 'options'))}, {_set('tid', 'data')}, "
        f"{_if(_STATUS_P, _set('600', 'option_data'))}, {_damage(2) if damaged else EMPTY})"
    )
    header = _words(("10", 2), ("length(sets) + 16", 2), ("secs", 4), ("o_orderkey", 4), ("o_custkey % 16", 4))
    return _datagrams(
        framed.selectExpr("*", f"{sets} AS sets"), "o_custkey", "ipfix", "o_orderdate", "o_orderkey", f"concat({header}, sets)"
    )


def netflow9_datagrams(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """One NetFlow v9 packet per order, announced and damaged as in :func:`ipfix_datagrams`.

    Octets come in 4 bytes and flags in 1, as most v9 exporters send them; every record has a
    MAC and an IPv6 address.
    """
    rows = table(spark, sf_dir, "orders").selectExpr(*_ORDER_COLUMNS)
    template = _words(
        ("tid", 2), ("12", 2), ("8", 2), ("4", 2), ("12", 2), ("4", 2), ("interface_id", 2), ("4", 2), ("4", 2), ("1", 2),
        ("6", 2), ("1", 2), ("7", 2), ("2", 2), ("11", 2), ("2", 2), ("1", 2), ("4", 2), ("2", 2), ("8", 2),
        ("21", 2), ("4", 2), ("56", 2), ("6", 2), ("27", 2), ("16", 2),
    )
    options = _words(
        ("600", 2), ("4", 2), ("8", 2), ("10", 2), ("4", 2), ("34", 2), ("4", 2), ("35", 2), ("1", 2)
    )

    def record(leg: int) -> str:
        ends = ("dst", "src") if leg == 1 else ("src", "dst")
        return _words(
            (ends[0], 4), (ends[1], 4), (500 + leg, 4), ([6, 17, 1][leg], 1), ("16", 1), ("src_port", 2), ("dst_port", 2),
            (f"octets + {leg}", 4), ("legs", 8), ("o_orderkey", 4), ("512", 2), ("o_custkey", 4),
            ("536939960", 4), ("0", 8), (f"asn + {leg}", 4),
        )

    data = f"concat({record(0)}, {_if('legs >= 2', record(1))}, {_if('legs >= 3', record(2))})"
    option_data = _words(("o_custkey", 4), ("1000", 4), ("2", 1))
    framed = rows.selectExpr("*", f"{template} AS template", f"{options} AS options", f"{data} AS data", f"{option_data} AS option_data")
    sets = (
        f"concat({_if(_STATUS_F, _set('0', 'template'))}, "
        f"{_if(_STATUS_P, _set('1', 'options'))}, {_set('tid', 'data')}, "
        f"{_if(_STATUS_P, _set('600', 'option_data'))}, {_damage(0) if damaged else EMPTY})"
    )
    header = _words(("9", 2), ("legs", 2), ("357280", 4), ("secs", 4), ("o_orderkey", 4), ("o_custkey % 16", 4))
    return _datagrams(framed, "o_custkey", "netflowv9", "o_orderdate", "o_orderkey", f"concat({header}, {sets})")


# ------------------------------------------------------------------ sFlow


def sflow_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sFlow v5 datagram per ``lineitem`` row: a flow sample, a counter sample and, for
    returned lines, a sample of a format nobody knows between them.

    Sampled headers: flag N raw IP, else Ethernet (with a VLAN tag for status F); IPv6 for even
    line numbers; UDP for line 2, ICMP for 3, ICMPv6 for 4, else TCP. Lines with quantity 50 are
    ARP frames where they are Ethernet, which spoils their whole datagram. Agents with status O
    have IPv6 addresses. The kind of counters follows the line number.
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        "CAST(l_quantity AS INT) AS qty",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
        "l_linenumber % 2 = 0 AS six",
        "l_returnflag = 'N' AS raw",
        "l_returnflag = 'R' AS strange",
        "CASE l_linenumber WHEN 2 THEN 17 WHEN 3 THEN 1 WHEN 4 THEN 58 ELSE 6 END AS ip_proto",
        "3232235520 + l_suppkey % 65536 AS src",
        "2886729728 + l_partkey % 65536 AS dst",
        "1024 + l_suppkey % 60000 AS src_port",
        "l_partkey % 65536 AS dst_port",
    )
    tcp = _words(
        ("src_port", 2), ("dst_port", 2), ("l_orderkey", 4), ("0", 4), ("20480 + 256 + l_linenumber", 2), ("1024", 2), ("0", 4)
    )
    udp = _words(("src_port", 2), ("dst_port", 2), ("8", 2), ("0", 2))
    icmp = _words(("8", 1), ("qty", 1), ("0", 2), ("l_partkey", 4))
    l4 = f"CASE ip_proto WHEN 6 THEN {tcp} WHEN 17 THEN {udp} ELSE {icmp} END"
    v4 = _words(
        ("17680", 2), ("qty + 40", 2), ("l_orderkey", 2), ("16384", 2), ("62", 1), ("ip_proto", 1), ("l_partkey", 2), ("src", 4), ("dst", 4)
    )
    v6 = _words(
        ("1629701479", 4), ("qty + 40", 2), ("ip_proto", 1), ("64", 1), ("536939960", 4), ("0", 8), ("l_suppkey + 1", 4),
        ("536939960", 4), ("65536", 4), ("0", 4), ("l_partkey + 1", 4),
    )
    ether_type = "CASE WHEN qty = 50 THEN X'0806' WHEN six THEN X'86DD' ELSE X'0800' END"
    tag = _if("l_linestatus = 'F'", _words(("33024", 2), ("8192 + qty", 2)))
    ethernet = f"concat({_words(('513', 2), ('l_partkey', 4), ('514', 2), ('l_suppkey', 4))}, {tag}, {ether_type}, l3)"
    raw_header = (
        f"concat({_words(('IF(raw, IF(six, 12, 11), 1)', 4), ('qty * 20 + 64', 4), ('4', 4), ('length(packet)', 4))}, "
        "packet, substring(X'000000', 1, pmod(-length(packet), 4)))"
    )
    ext_switch = _words(("qty", 4), ("1", 4), ("qty + 1", 4), ("2", 4))
    ext_router = _words(("1", 4), ("184483840 + l_suppkey % 65536", 4), ("24", 4), ("16", 4))
    flow_sample = (
        f"concat({_words(('l_orderkey', 4), ('1', 1), ('l_suppkey', 3), ('4096', 4), ('cents', 4), ('qty', 4), ('536', 4), ('728', 4), ('3', 4))}, "
        f"{_tagged('1', 'raw_header')}, {_tagged('1001', ext_switch, 16)}, {_tagged('1002', ext_router, 16)})"
    )
    kinds = list(COUNTER_WIDTHS)
    # word i of a counter record is cents + i, or 1000 cents + i in 8-byte words
    bodies = [
        _words(*[(f"cents + {i}" if width == 4 else f"cents * 1000 + {i}", width) for i, width in enumerate(widths)])
        for widths in COUNTER_WIDTHS.values()
    ]
    kind = "CASE l_linenumber % 6 " + " ".join(f"WHEN {(i + 1) % 6} THEN {k}" for i, k in enumerate(kinds)) + " END"
    body = "CASE l_linenumber % 6 " + " ".join(f"WHEN {(i + 1) % 6} THEN {x}" for i, x in enumerate(bodies)) + " END"
    counter_sample = f"concat({_words(('l_orderkey', 4), ('0', 1), ('l_partkey', 3), ('1', 4))}, {_tagged('kind', 'counters')})"
    address = (
        f"IF(l_linestatus = 'O', {_words(('2', 4), ('536939960', 4), ('0', 8), ('l_suppkey', 4))}, "
        f"{_words(('1', 4), ('167772160 + l_suppkey % 16777216', 4))})"
    )
    header = f"concat({_word('5', 4)}, {address}, {_words(('7', 4), ('l_orderkey', 4), ('3600000', 4), ('IF(strange, 3, 2)', 4))})"
    staged = (
        rows.selectExpr("*", f"concat(IF(six, {v6}, {v4}), {l4}) AS l3", f"{kind} AS kind", f"{body} AS counters")
        .selectExpr("*", f"IF(raw, l3, {ethernet}) AS packet")
        .selectExpr("*", f"{raw_header} AS raw_header")
        .selectExpr("*", f"{flow_sample} AS flow_sample", f"{counter_sample} AS counter_sample")
    )
    payload = (
        f"concat({header}, {_tagged('1', 'flow_sample')}, {_if('strange', _tagged('9', _word('1', 4), 4))}, "
        f"{_tagged('2', 'counter_sample')})"
    )
    return _datagrams(staged, "l_suppkey", "sflow", "l_shipdate", "l_orderkey * 8 + l_linenumber", payload)


# Bytes per counter word of each record format.
COUNTER_WIDTHS = {
    1: [4, 4, 8, 4, 4, 8, 4, 4, 4, 4, 4, 4, 8, 4, 4, 4, 4, 4, 4],
    2: [4] * 13,
    3: [4] * 18,
    4: [4, 8, 4, 8, 4, 4, 4, 4, 4, 8, 4, 8, 8, 8],
    5: [4, 8, 4, 4, 4, 4],
    1001: [4, 4, 4, 8, 8],
}


def all_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datagrams of all four protocols."""
    parts = [netflow5_datagrams, ipfix_datagrams, netflow9_datagrams, sflow_datagrams]
    result = parts[0](spark, sf_dir)
    for part in parts[1:]:
        result = result.unionByName(part(spark, sf_dir))
    return result


# ------------------------------------------------------------------ collector statistics

_PROTO = """CASE event_type WHEN 'view' THEN 'sflow' WHEN 'purchase' THEN 'netflowv5'
            WHEN 'signup' THEN 'netflowv9' ELSE 'ipfix' END"""


def datagram_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per received datagram with what became of it, from ``events``."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('host', user_id % 8) AS host",
        f"{_PROTO} AS proto",
        "ts",
        "event_id",
        "CAST(user_id % 16 AS INT) AS partition",
        "value >= 5 AS decoded",
        "event_type = 'error' AS publish_error",
        "CAST(floor(value) AS BIGINT) AS size",
    )


def collector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly polls of running counters per host and protocol; counters restart every week."""
    hourly = (
        datagram_log(spark, sf_dir)
        .groupBy("host", "proto", F.date_trunc("hour", "ts").alias("ts"))
        .agg(
            F.count("*").alias("n"),
            F.count_if("decoded").alias("d"),
            F.count_if("publish_error").alias("e"),
            F.sum("size").alias("s"),
        )
        .withColumn("start_time", F.unix_timestamp(F.date_trunc("week", "ts")))
    )
    run = Window.partitionBy("host", "proto", "start_time").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select(
        "host",
        "proto",
        "ts",
        "start_time",
        F.sum("n").over(run).alias("udp_count"),
        F.sum("d").over(run).alias("decoded_count"),
        F.sum("e").over(run).alias("mq_error_count"),
        F.col("n").alias("udp_queue"),
        (F.col("s") % 1000).alias("message_queue"),
        (F.col("n") % 16 + 1).alias("workers"),
        F.when(F.col("proto") == "ipfix", F.col("s") % 7).alias("udp_mirror_queue"),
    )
